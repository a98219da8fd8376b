"""Model endpoints: one chat-completions protocol, reached with the standard library, and the errors it can give.

A responder is any callable(request: dict) -> dict with ``text`` (None where the model gave no choice), ``input_tokens`` and ``output_tokens``.
A request has model, prompt, temperature, max_tokens and, where set, seed.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable

#: HTTP statuses worth another try.
RETRY_STATUS = (408, 409, 425, 429, 500, 502, 503, 504)


class ModelNotConfigured(Exception):
    """The configuration names no such model, or leaves its name open."""


class CredentialsMissing(Exception):
    """The environment lacks what the provider needs."""


class EndpointError(Exception):
    """A call that the endpoint refused or that did not reach it; ``status`` is None for the latter."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status

    @property
    def transient(self) -> bool:
        return self.status is None or self.status in RETRY_STATUS


class TransientFailure(Exception):
    """Retries are used up, or the answer was empty."""


#: Errors that fail one row; anything else is a fault of the program and ends the job.
ROW_ERRORS = (ModelNotConfigured, CredentialsMissing, EndpointError, TransientFailure)

_LOCAL = "http://localhost:8000/v1"


#: Environment variables that a provider needs.
CREDENTIALS = {"azure_openai": ("AZURE_OPENAI_API_KEY", "AZURE_OPENAI_ENDPOINT"), "nvidia_build": ("NVIDIA_API_KEY",)}


def missing_credential(provider: str) -> str | None:
    """What the environment lacks for the provider, if anything."""
    absent = [k for k in CREDENTIALS.get(provider, ()) if not os.environ.get(k)]
    return f"{' and '.join(absent)} not set" if absent else None


def local_server_up(base: str = _LOCAL, timeout: float = 2.0) -> bool:
    try:
        with urllib.request.urlopen(f"{base}/models", timeout=timeout):
            return True
    except OSError:
        return False


def _endpoint(provider: str, model: str) -> tuple[str, dict[str, str]]:
    if lack := missing_credential(provider):
        raise CredentialsMissing(f"{provider}: {lack}")
    env = os.environ
    if provider == "azure_openai":
        return f"{env['AZURE_OPENAI_ENDPOINT'].rstrip('/')}/openai/deployments/{model}/chat/completions?api-version=2024-10-21", {"api-key": env["AZURE_OPENAI_API_KEY"]}
    if provider == "nvidia_build":
        return "https://integrate.api.nvidia.com/v1/chat/completions", {"Authorization": f"Bearer {env['NVIDIA_API_KEY']}"}
    if provider == "local_hf":
        return f"{_LOCAL}/chat/completions", {}
    raise ValueError(f"unknown provider {provider!r}")


def credential_of(provider: str) -> str | None:
    """A digest of what the environment has for the provider: a client is kept as long as this stays."""
    from hashlib import sha256

    names = CREDENTIALS.get(provider, ())
    return sha256("\n".join(os.environ.get(k, "") for k in names).encode()).hexdigest() if names else None


_clients: dict[tuple, Callable[[dict], dict]] = {}


def client(responder: Callable[[str], Callable[[dict], dict]], provider: str) -> Callable[[dict], dict]:
    """The worker's callable for a provider, made anew when the responder or the credential changes."""
    key = (responder, provider, credential_of(provider))
    if key not in _clients:
        for old in [k for k in _clients if k[1] == provider]:
            del _clients[old]
        _clients[key] = responder(provider)
    return _clients[key]


def http_responder(provider: str) -> Callable[[dict], dict]:
    """Calls the provider's endpoint.  Credentials are looked up at each call, so a corrected environment takes effect."""

    def respond(request: dict) -> dict:
        url, headers = _endpoint(provider, request["model"])
        body = {"model": request["model"], "messages": [{"role": "user", "content": request["prompt"]}], "temperature": request["temperature"], "max_tokens": request["max_tokens"]}
        if request.get("seed") is not None:
            body["seed"] = request["seed"]
        call = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        try:
            with urllib.request.urlopen(call, timeout=120) as reply:
                answer = json.load(reply)
        except urllib.error.HTTPError as e:
            raise EndpointError(f"{provider}: HTTP {e.code}", e.code) from e
        except OSError as e:
            raise EndpointError(f"{provider}: {e}") from e
        choices, usage = answer.get("choices") or [], answer.get("usage") or {}
        text = (choices[0]["message"].get("content") or "") if choices else None
        return {"text": text, "input_tokens": usage.get("prompt_tokens") or 0, "output_tokens": usage.get("completion_tokens") or 0}

    return respond
