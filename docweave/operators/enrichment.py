"""The enrichment runtime: providers, structured calls with retry, audit first and results from the audit."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.codecs import repair
from ..plans.schema import Schema
from .assembly import full_prompt, truncate_input
from .providers import service
from .storage import attempt_id


class Provider(Protocol):
    """A model service. One is made per task, inside the worker."""

    def generate_text(self, prompt: str, system: str | None, model: str, temperature: float) -> str: ...

    def generate_structured(self, prompt: str, system: str | None, model: str, fields: list[dict], temperature: float) -> str: ...

    def count_tokens(self, text: str, model: str) -> int: ...

    def max_context_tokens(self, model: str) -> int: ...


class StubProvider:
    """Answers from a hash of the prompt: deterministic, offline, and always valid for its fields."""

    def generate_text(self, prompt, system=None, model="stub", temperature=0.0):
        return hashlib.sha256(f"{model}|{system or ''}|{prompt}".encode()).hexdigest()[:16]

    def generate_structured(self, prompt, system=None, model="stub", fields=(), temperature=0.0):
        out: dict[str, Any] = {}
        for f in fields:
            n = int(hashlib.sha256(f"{model}|{f['name']}|{prompt}".encode()).hexdigest()[:8], 16)
            if f.get("choices"):
                pick = f["choices"][n % len(f["choices"])]
                out[f["name"]] = [pick] if f.get("many") else pick
            elif f["kind"] == "integer":
                low = int(f.get("minimum") or 0)
                high = int(f.get("maximum") if f.get("maximum") is not None else low + 100)
                out[f["name"]] = low + n % (high - low + 1)
            elif f["kind"] == "float":
                low = float(f.get("minimum") or 0)
                high = float(f.get("maximum") if f.get("maximum") is not None else low + 1)
                out[f["name"]] = round(low + (high - low) * (n % 1000) / 1000, 3)
            elif f["kind"] == "boolean":
                out[f["name"]] = n % 2 == 0
            elif f["kind"] == "array":
                out[f["name"]] = [f"{n:08x}"]
            elif f["kind"] == "object":
                out[f["name"]] = {}
            else:
                out[f["name"]] = "中文" if f.get("lang") == "zh" else f"{n:08x}"
        return json.dumps(out, ensure_ascii=False)

    def count_tokens(self, text, model="stub"):
        return len(text) // 4

    def max_context_tokens(self, model="stub"):
        return 128000


_PROVIDERS: dict[str, Callable[[], Provider]] = {"stub": StubProvider}


def register_provider(prefix: str, factory: Callable[[], Provider]) -> None:
    """``factory`` serves models whose name holds ``prefix``; it must be importable on the workers."""
    _PROVIDERS[prefix] = factory


def provider_for(model: str) -> Callable[[], Provider]:
    """The registered factory whose prefix the model's name holds, else that of the two services; an error for any other model."""
    own = next((f for p, f in reversed(_PROVIDERS.items()) if p in model and (p != "stub" or model.startswith(p))), None)
    return own or service(model)


def served(model: str) -> bool:
    """Whether a registered factory (the stub's included) serves the model."""
    return any(p in model and (p != "stub" or model.startswith(p)) for p in _PROVIDERS)


@dataclass
class Task:
    """What to ask of each row."""

    name: str
    template: str
    inputs: list[str]
    schema: Schema
    model: str = "stub"
    system: str | None = None
    key: str = "sha1"
    temperature: float = 0.0
    attempts: int = 3
    margin: int = 2000
    free_text: bool = False  # ask for text, with instructions on its form in the prompt, instead of a structured answer


def with_prompts(rows: DataFrame, task: Task) -> DataFrame:
    """``full_prompt`` per row: the template filled in, then the inputs, cut to the model's window."""
    values = {x.partition(":")[0].strip(): F.col(f"`{x.partition(':')[0].strip()}`") for x in task.inputs}
    short = {n: truncate_input(F.lit(task.template), F.coalesce(v.cast("string"), F.lit("")), task.model, task.margin) for n, v in values.items()}
    prompt = full_prompt(task.template, short)
    if task.free_text:
        prompt = F.concat(prompt, F.lit("\n\n" + task.schema.instructions()))
    return rows.withColumn("full_prompt", prompt)


def _parse(answer: str) -> str | None:
    """The JSON object in an answer, also inside a code fence or prose; None if there is none."""
    for text in (answer, answer[answer.find("{") : answer.rfind("}") + 1]):
        try:
            if isinstance(json.loads(text), dict):
                return text
        except ValueError:
            pass
    return None


def as_object(answer: str, fields: list[dict]) -> str:
    """A free text as the JSON object that the schema reads: the object in it, or its whole text as the only field's value."""
    healed = repair(answer).strip()
    if (found := _parse(healed)) is not None:
        return found
    if len(fields) != 1:
        raise ValueError("the answer is not JSON")
    bare = re.sub(r"^```\w*\s*|\s*```$", "", healed)
    try:
        value = json.loads(bare)
    except ValueError:
        value = bare
    return json.dumps({fields[0]["name"]: value}, ensure_ascii=False)


def call_model(rows: DataFrame, task: Task, factory: Callable[[], Provider] | None = None, language: Callable[[dict], str | None] | None = None) -> DataFrame:
    """One model call per row with retries for a wrong language only; structured, or free text whose broken encoding is repaired.

    The call sits in ``mapInPandas``, which the optimizer neither repeats nor moves filters through. Errors are data.
    """
    factory = factory or provider_for(task.model)
    fields = [{"name": f.name, "kind": f.kind, "choices": f.choices, "many": f.many, "minimum": f.minimum, "maximum": f.maximum, "lang": f.lang} for f in task.schema.fields]
    model, system, temperature, attempts, free = task.model, task.system, task.temperature, task.attempts, task.free_text
    check = language or _language_problem

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for pdf in batches:
            out = []
            for key, prompt in zip(pdf["sha1"], pdf["full_prompt"]):
                raw = error = None
                attempt = 0
                for attempt in range(1, attempts + 1):
                    try:
                        if free:
                            raw = as_object(provider.generate_text(prompt, system, model, temperature), fields)
                        else:
                            answer = provider.generate_structured(prompt, system, model, fields, temperature)
                            raw = _parse(answer)
                        if raw is None:
                            raw, error = repair(answer), "the answer is not JSON"
                            break
                        error = check(json.loads(raw), fields)
                        if error is None:
                            break
                    except Exception as e:  # noqa: BLE001 - a failed call is a row in the audit log
                        raw, error = None, f"{type(e).__name__}: {e}"
                        break
                out.append((key, prompt, raw, error, attempt))
            yield pd.DataFrame(out, columns=["sha1", "full_prompt", "raw_json", "error", "attempt"]).astype({"attempt": "int32"})

    return rows.select(F.col(task.key).alias("sha1"), "full_prompt").mapInPandas(run, "sha1 string, full_prompt string, raw_json string, error string, attempt int")


def _language_problem(answer: dict, fields: list[dict]) -> str | None:
    hanzi = lambda s: any("㐀" <= ch <= "鿿" or "豈" <= ch <= "﫿" or "\U00020000" <= ch <= "\U0002fa1f" for ch in s)
    for f in fields:
        for x in (v if isinstance(v := answer.get(f["name"]), list) else [v]):
            if f.get("lang") in ("zh", "en") and isinstance(x, str) and x and hanzi(x) != (f["lang"] == "zh"):
                return f"{f['name']}: not in language {f['lang']}"
    return None


def audited(calls: DataFrame, task: Task, prompt_id: str | None = None, now: Column | None = None, run: str | None = None) -> DataFrame:
    """Calls as audit rows, success and failure alike. ``run`` tells the attempts of one run from those of another."""
    return calls.select(
        attempt_id(F.col("sha1"), F.lit(task.name), F.lit(task.model), F.col("attempt"), run).alias("enrichment_id"), "sha1", F.lit(task.name).alias("enrichment_name"), "raw_json", F.lit(task.model).alias("model_used"),
        F.lit(prompt_id).cast("string").alias("prompt_id"), "full_prompt", "error", F.col("attempt").cast("int").alias("attempt"), (F.current_timestamp() if now is None else now).alias("created_at"),
    )


def results(audit: DataFrame, task: Task) -> DataFrame:
    """Typed results of a task from its audit rows; rows with errors are left out."""
    rows = audit.where((F.col("enrichment_name") == task.name) & (F.col("model_used") == task.model) & F.col("error").isNull())
    parsed = rows.withColumn("_p", task.schema.parse(F.col("raw_json"))).where(F.size("_p.errors") == 0)
    return parsed.select("sha1", "model_used", "enrichment_id", *[F.col(f"_p.`{n}`").alias(n) for n in task.schema.names])


def rejected(audit: DataFrame, task: Task) -> DataFrame:
    """Answers that do not fit the schema, with the messages."""
    rows = audit.where((F.col("enrichment_name") == task.name) & (F.col("model_used") == task.model))
    parsed = rows.withColumn("_p", task.schema.parse(F.col("raw_json")))
    return parsed.where(F.col("error").isNotNull() | (F.size("_p.errors") > 0)).select("sha1", "model_used", F.coalesce("error", F.array_join("_p.errors", "; ")).alias("error"))


def run_task(rows: DataFrame, task: Task, audit_table, factory: Callable[[], Provider] | None = None) -> DataFrame:
    """Ask, write the audit rows, and read the results back from what was written: no call is made twice."""
    audit_table.append(audited(call_model(with_prompts(rows, task), task, factory), task))
    return results(audit_table.read(), task)


# Agreement of models, and backfills.


def agreement(derived: DataFrame, column: str, a: str, b: str, key: str = "sha1") -> DataFrame:
    """Per key the two models' values side by side; one exchange, no self-join."""
    pick = lambda m: F.max(F.when(F.col("model_used") == m, F.col(column)))
    both = derived.where(F.col("model_used").isin(a, b)).groupBy(key).agg(pick(a).alias("value_a"), pick(b).alias("value_b"))
    return both.where(F.col("value_a").isNotNull() & F.col("value_b").isNotNull()).withColumn("agree", F.col("value_a") == F.col("value_b"))


def latest_model(audit: DataFrame, key: str = "sha1") -> DataFrame:
    return audit.groupBy(key).agg(F.max_by("model_used", F.struct("created_at", "enrichment_id")).alias("model_used"))


# Translation line by line.


def translate_lines(docs: DataFrame, key: str, text: str, translate: Callable[[list[str]], list[str] | None], chunk: int = 3, retries: int = 1) -> DataFrame:
    """Non-blank lines translated ``chunk`` at a time; (key, lines) with a JSON map of line number to translation.

    ``translate`` gives as many lines as it gets, or None or an exception for failure; after ``retries`` more tries a chunk is blank.
    Lines of a document are parted and rejoined within one row, so nothing is exchanged.
    """

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            lines = [x for x in (t or "").split("\n") if x.strip()]
            out = {}
            for at in range(0, len(lines), chunk):
                part, got = lines[at : at + chunk], None
                for _ in range(retries + 1):
                    try:
                        got = translate(part)
                    except Exception:  # noqa: BLE001 - a failed chunk is blank
                        got = None
                    if got is not None and len(got) == len(part):
                        break
                    got = None
                out.update({str(at + i + 1): (got[i] if got else "") for i in range(len(part))})
            return out

        return texts.map(one)

    return docs.select(F.col(key), F.to_json(run(F.col(text))).alias("lines"))
