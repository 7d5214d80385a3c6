"""Model services behind one protocol: the offline stub, and two HTTP services with an injectable transport.

A factory is made on the driver and goes to the tasks, where it makes one provider each. Nothing falls back to the
stub: a model that no factory serves is an error.
"""

from __future__ import annotations

import functools
import json
import os
import urllib.request
from collections.abc import Callable
from typing import Any

Transport = Callable[[str, dict[str, str], dict[str, Any]], dict[str, Any]]
_KINDS = {"integer": "integer", "float": "number", "boolean": "boolean", "array": "array", "object": "object", "string": "string"}
WINDOWS = {"gpt-4": 8192, "gpt-4-32k": 32768, "gpt-3.5-turbo": 16385, "gpt-3.5-turbo-16k": 16385}


class ModelError(ValueError):
    """A model that cannot be served, or an answer that is none."""


def post(url: str, headers: dict[str, str], body: dict[str, Any], timeout: float = 120) -> dict[str, Any]:
    """The transport that is used where none is given."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310 - the address is the service's
        return json.load(answer)


def json_schema(fields: list[dict]) -> dict[str, Any]:
    """JSON Schema of an answer with these fields."""
    properties = {}
    for f in fields:
        one: dict[str, Any] = {"type": _KINDS[f["kind"]]}
        if f.get("choices"):
            choice = {"type": "string", "enum": list(f["choices"])}
            one = {"type": "array", "items": choice} if f.get("many") else choice
        elif f["kind"] == "array":
            one["items"] = {"type": "string"}
        one |= {k: f[k] for k in ("minimum", "maximum") if f.get(k) is not None}
        properties[f["name"]] = one
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


class _Http:
    def __init__(self, api_key: str, transport: Transport | None = None):
        self.api_key, self.transport = api_key, transport or post

    def count_tokens(self, text: str, model: str) -> int:
        """By the model's own encoding where its file is at hand (``TIKTOKEN_CACHE_DIR``), else four characters a token."""
        if os.environ.get("TIKTOKEN_CACHE_DIR"):
            try:
                import tiktoken

                return len(tiktoken.encoding_for_model(model).encode(text, disallowed_special=()))
            except Exception:  # noqa: BLE001 - no such encoding here
                pass
        return len(text) // 4

    def max_context_tokens(self, model: str) -> int:
        return WINDOWS.get(model, 128_000)


class OpenAIProvider(_Http):
    """Chat completions; structured answers by a JSON Schema."""

    url = "https://api.openai.com/v1/chat/completions"

    def _ask(self, prompt, system, model, temperature, more):
        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
        answer = self.transport(self.url, {"Authorization": f"Bearer {self.api_key}"}, {"model": model, "messages": messages, "temperature": temperature, **more})
        text = ((answer.get("choices") or [{}])[0].get("message") or {}).get("content")
        if not text:
            raise ModelError("the model gave no answer")
        return text

    def generate_text(self, prompt, system=None, model="gpt-4o-mini", temperature=0.0):
        return self._ask(prompt, system, model, temperature, {})

    def generate_structured(self, prompt, system=None, model="gpt-4o-mini", fields=(), temperature=0.0):
        schema = {"name": "answer", "strict": True, "schema": json_schema(list(fields))}
        return self._ask(prompt, system, model, temperature, {"response_format": {"type": "json_schema", "json_schema": schema}})


class GeminiProvider(_Http):
    """generateContent; structured answers by a response schema."""

    url = "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent"

    def _ask(self, prompt, system, model, temperature, more):
        body: dict[str, Any] = {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": {"temperature": temperature, **more}}
        if system:
            body["systemInstruction"] = {"parts": [{"text": system}]}
        answer = self.transport(self.url.format(model=model), {"x-goog-api-key": self.api_key}, body)
        parts = ((answer.get("candidates") or [{}])[0].get("content") or {}).get("parts") or []
        text = "".join(p.get("text", "") for p in parts)
        if not text:
            raise ModelError("the model gave no answer")
        return text

    def generate_text(self, prompt, system=None, model="gemini-2.5-flash", temperature=0.0):
        return self._ask(prompt, system, model, temperature, {})

    def generate_structured(self, prompt, system=None, model="gemini-2.5-flash", fields=(), temperature=0.0):
        schema = json_schema(list(fields))
        schema.pop("additionalProperties")
        return self._ask(prompt, system, model, temperature, {"responseMimeType": "application/json", "responseSchema": schema})

    def max_context_tokens(self, model):
        return 1_000_000


def service(model: str, transport: Transport | None = None) -> Callable[[], Any]:
    """A factory for a model of the two services, with the key from the driver's environment."""
    low = model.lower()
    if "gemini" in low:
        make, names = GeminiProvider, ("GEMINI_API_KEY", "GOOGLE_API_KEY")
    elif low.startswith(("gpt-", "o1", "o3", "o4", "chatgpt-")):
        make, names = OpenAIProvider, ("OPENAI_API_KEY",)
    else:
        raise ModelError(f"no provider serves the model {model!r}; register one, or use a model whose name begins with 'stub'")
    key = next((os.environ[n] for n in names if os.environ.get(n)), None)
    if not key:
        raise ModelError(f"{' or '.join(names)} must be set for the model {model!r}")
    return functools.partial(make, key, transport)
