"""Settings: a file of key=value lines with aliases, and what they decide."""

from __future__ import annotations

from collections.abc import Mapping, MutableMapping

#: Models and providers by mode.
DEFAULTS = {
    "openai": {"LLM_PROVIDER": "openai", "EMBEDDING_PROVIDER": "openai", "EMBEDDING_MODEL": "text-embedding-3-small"},
    "local": {"LLM_PROVIDER": "local", "EMBEDDING_PROVIDER": "sentence-transformers", "EMBEDDING_MODEL": "intfloat/multilingual-e5-base"},
}
#: Retrieval unless a request says otherwise.
RETRIEVAL = {"mode": "hybrid", "vector_backend": "faiss", "top_k": 5, "query_rewrite": True}
TOP_K = (1, 20)


def parse(text: str) -> dict[str, str]:
    """Lines ``key=value``; comments, empty lines and quotes around values go."""
    out: dict[str, str] = {}
    for line in map(str.strip, text.splitlines()):
        key, sign, value = line.partition("=")
        if sign and key.strip() and not line.startswith("#"):
            out[key.strip()] = value.strip().strip('"').strip("'")
    return out


def load(text: str, aliases: Mapping[str, list[str]], env: MutableMapping[str, str]) -> None:
    """Of each setting, the first alias that has a value; what is set already stays."""
    found = parse(text)
    for target, names in aliases.items():
        value = next((found[n] for n in names if found.get(n)), None)
        if value:
            env.setdefault(target, value)


def updated(text: str, values: Mapping[str, str]) -> str:
    """The file with these settings: in place where they are, else at its end."""
    left, lines = dict(values), []
    for line in text.splitlines():
        key = line.partition("=")[0].strip()
        known = "=" in line and not line.lstrip().startswith("#") and key in left
        lines.append(f"{key}={left.pop(key)}" if known else line)
    if left and lines and lines[-1].strip():
        lines.append("")
    return "\n".join([*lines, *(f"{k}={v}" for k, v in left.items())]) + "\n"


def mode(env: Mapping[str, str]) -> str:
    found = env.get("RAG_MODE", "openai").strip().casefold()
    if found not in DEFAULTS:
        raise ValueError(f"RAG_MODE: one of {', '.join(DEFAULTS)}")
    return found


def setting(env: Mapping[str, str], key: str) -> str:
    """A provider or model: as set, else by the mode."""
    value = env.get(key) or DEFAULTS[mode(env)][key]
    return value.strip().casefold() if key.endswith("PROVIDER") else value


def origins(fixed: tuple[str, ...], more: str | None) -> list[str]:
    """Allowed origins: fixed ones and those listed, each once, in order."""
    return list(dict.fromkeys([*fixed, *(x.strip() for x in (more or "").split(",") if x.strip())]))


def settings(given: Mapping | None) -> dict:
    """A request's retrieval settings over the usual ones, within their bounds."""
    out = RETRIEVAL | {k: v for k, v in (given or {}).items() if k in RETRIEVAL and v is not None}
    out["top_k"] = max(TOP_K[0], min(TOP_K[1], int(out["top_k"])))
    return out
