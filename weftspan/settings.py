"""Settings of a crawl: defaults, then a file, then the environment, then the command line."""

from __future__ import annotations

import dataclasses
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from . import __version__
from .functions.urls import DEFAULT_SCHEMES

PREFIX = "WEFT_"
#: The least delay in seconds, and headers that can't be set by hand.
LEAST_DELAY, FORBIDDEN = 0.1, ("host", "content-length", "connection")


class SettingsError(ValueError):
    pass


@dataclass
class Auth:
    """kind: '', 'basic', 'bearer' or 'api-key'. A *_env field names a variable, which wins over the plain field."""

    kind: str = ""
    username: str = ""
    password: str = field(default="", repr=False)
    token: str = field(default="", repr=False)
    header: str = ""
    value: str = field(default="", repr=False)
    username_env: str = ""
    password_env: str = ""
    token_env: str = ""
    header_env: str = ""
    value_env: str = ""

    #: The fields that each kind needs.
    NEEDS = {"basic": ("username", "password"), "bearer": ("token",), "api-key": ("header", "value")}

    def get(self, name: str, env: Mapping[str, str] | None = None) -> str:
        source = getattr(self, f"{name}_env")
        return (os.environ if env is None else env).get(source, "") if source else getattr(self, name)

    def check(self, env: Mapping[str, str] | None = None) -> None:
        used = [k for k, names in self.NEEDS.items() if any(getattr(self, n) or getattr(self, f"{n}_env") for n in names)]
        if len(used) > 1:
            raise SettingsError(f"only one way of authentication can be set, found {', '.join(used)}")
        if self.kind and self.kind not in self.NEEDS:
            raise SettingsError(f"unknown way of authentication: {self.kind}")
        if missing := [n for n in self.NEEDS.get(self.kind, ()) if not self.get(n, env)]:
            raise SettingsError(f"{self.kind} authentication needs {' and '.join(missing)}")


@dataclass
class Settings:
    seed_urls: list[str] = field(default_factory=list)
    concurrency: int = 2
    request_delay: float = 0.1
    request_timeout: float = 30.0
    user_agent: str = f"weftspan/{__version__}"
    ignore_robots_txt: bool = False
    follow_external_hosts: bool = False
    limit: int = 0
    include_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    allowed_schemes: list[str] = field(default_factory=lambda: list(DEFAULT_SCHEMES))
    headers: list[str] = field(default_factory=list)
    warehouse: str = "./crawl"
    log_level: str = "info"
    log_file: str = ""
    log_max_size: int = 100
    log_max_backups: int = 5
    log_console: bool = True
    auth: Auth = field(default_factory=Auth)

    def check(self, env: Mapping[str, str] | None = None) -> Settings:
        """These settings with the least delay kept; raises SettingsError for the first thing that is wrong."""
        if self.concurrency <= 0:
            raise SettingsError("concurrency must be above 0")
        if self.request_timeout <= 0:
            raise SettingsError("request_timeout must be above 0")
        out = dataclasses.replace(self, request_delay=max(LEAST_DELAY, self.request_delay))
        if not self.warehouse:
            raise SettingsError("warehouse must not be empty")
        self.auth.check(env)
        for h in self.headers:
            parsed_header(h)
        return out

    def shown(self) -> dict[str, Any]:
        """All settings but secrets."""
        out = dataclasses.asdict(self)
        out["auth"] = {"kind": self.auth.kind, **{k: "***" for k in ("username", "password", "token", "value") if getattr(self.auth, k)}}
        return out


def parsed_header(text: str) -> tuple[str, str]:
    """Name and value of 'Name: Value'."""
    name, colon, value = text.partition(":")
    name, value = name.strip(), value.strip()
    if not colon or not name or not value:
        raise SettingsError(f"a header is 'Name: Value', not {text!r}")
    if name.lower() in FORBIDDEN:
        raise SettingsError(f"the header {name} can't be set")
    return name, value


def headers_map(headers: list[str]) -> dict[str, str]:
    """Headers by name, without those that have no name or value."""
    out = {}
    for h in headers:
        name, colon, value = h.partition(":")
        if colon and name.strip() and value.strip():
            out[name.strip()] = value.strip()
    return out


def env_headers(env: Mapping[str, str], prefix: str = PREFIX) -> list[str]:
    """'X-Custom: v' for WEFT_HEADER_X_CUSTOM=v."""
    start = f"{prefix}HEADER_"
    named = sorted((k[len(start) :], v) for k, v in env.items() if k.startswith(start) and k != start)
    return ["-".join(part.capitalize() for part in k.split("_")) + f": {v}" for k, v in named]


def merged_headers(headers: list[str], more: list[str]) -> list[str]:
    """headers in place; those of `more` replace one of the same name or come last."""
    out = list(headers)
    for h in more:
        name = h.partition(":")[0] + ":"
        at = next((k for k, x in enumerate(out) if x.startswith(name)), None)
        if at is None:
            out.append(h)
        else:
            out[at] = h
    return out


def seconds(value: str | float) -> float:
    """A duration: a number of seconds, or parts such as 1m30s and 500ms."""
    if isinstance(value, (int, float)):
        return float(value)
    if re.fullmatch(r"\s*[0-9.]+\s*", value):
        return float(value)
    units = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}
    parts = re.findall(r"([0-9.]+)(ms|h|m|s)", value)
    if not parts or "".join(a + b for a, b in parts) != value.strip():
        raise SettingsError(f"not a duration: {value!r}")
    return sum(float(a) * units[b] for a, b in parts)


def _cast(name: str, value: Any) -> Any:
    default = getattr(Settings(), name)
    if name in ("request_timeout", "request_delay"):
        return seconds(value)
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).lower() in ("1", "t", "true", "yes")
    if isinstance(default, list):
        return list(value) if isinstance(value, (list, tuple)) else [v for v in str(value).split(",") if v]
    try:
        return type(default)(value)
    except (TypeError, ValueError) as e:
        raise SettingsError(f"{name}: not a number: {value!r}" if isinstance(default, (int, float)) else f"{name}: {value!r}") from e


def parse_yaml(text: str) -> dict[str, Any]:
    """The part of YAML that settings need: nested maps by indent, lists, and plain or quoted values."""
    root: dict[str, Any] = {}
    stack: list[tuple[int, dict | list]] = [(-1, root)]
    last: tuple[dict, str] | None = None
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw) if "'" not in raw and '"' not in raw else raw
        if not line.strip() or line.strip().startswith("#"):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        if body.startswith("- ") or body == "-":
            if last and not isinstance(last[0][last[1]], list):
                last[0][last[1]] = []
            if not last:
                raise SettingsError(f"a list needs a name: {raw!r}")
            last[0][last[1]].append(_scalar(body[1:].strip()))
            continue
        while stack[-1][0] >= indent:
            stack.pop()
        key, colon, value = body.partition(":")
        if not colon:
            raise SettingsError(f"not 'name: value': {raw!r}")
        here = stack[-1][1]
        if value.strip():
            here[key.strip()] = _scalar(value.strip())
            last = None
        else:
            here[key.strip()] = {}
            last = (here, key.strip())
            stack.append((indent, here[key.strip()]))
    return root


def _scalar(text: str) -> Any:
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    if text in ("true", "false"):
        return text == "true"
    if text in ("null", "~"):
        return ""
    return int(text) if re.fullmatch(r"-?\d+", text) else float(text) if re.fullmatch(r"-?\d+\.\d*", text) else text


def dump_yaml(values: Mapping[str, Any], indent: int = 0) -> str:
    """Settings as YAML that parse_yaml() reads."""
    pad, out = " " * indent, []
    for k, v in values.items():
        if isinstance(v, Mapping):
            out.append(f"{pad}{k}:\n{dump_yaml(v, indent + 2)}" if v else f"{pad}{k}: null\n")
        elif isinstance(v, list):
            out.append(f"{pad}{k}: []\n" if not v else f"{pad}{k}:\n" + "".join(f'{pad}  - "{x}"\n' for x in v))
        elif isinstance(v, str):
            out.append(f'{pad}{k}: "{v}"\n')
        else:
            out.append(f"{pad}{k}: {str(v).lower() if isinstance(v, bool) else v}\n")
    return "".join(out)


AUTH_FILE = {("basic", "username"): "username", ("basic", "password"): "password", ("basic", "username_env"): "username_env", ("basic", "password_env"): "password_env", ("bearer", "token"): "token", ("bearer", "token_env"): "token_env", ("apikey", "header"): "header", ("apikey", "value"): "value", ("apikey", "header_env"): "header_env", ("apikey", "value_env"): "value_env"}


def load(file: Mapping[str, Any] | None = None, env: Mapping[str, str] | None = None, flags: Mapping[str, Any] | None = None, prefix: str = PREFIX) -> Settings:
    """Settings from the layers, later ones first; None in flags means not given."""
    file, env, flags = file or {}, os.environ if env is None else env, {k: v for k, v in (flags or {}).items() if v is not None}
    names = [f.name for f in dataclasses.fields(Settings) if f.name != "auth"]
    found: dict[str, Any] = {}
    for name in names:
        for value in (flags.get(name), env.get(prefix + name.upper()), file.get(name)):
            if value is not None:
                found[name] = _cast(name, value)
                break
    auth: dict[str, str] = {}
    given = file.get("auth") or {}
    for (part, name), to in AUTH_FILE.items():
        for value in (flags.get(f"auth_{name}"), env.get(f"{prefix}AUTH_{part}_{name}".upper()), (given.get(part) or {}).get(name)):
            if value is not None:
                auth[to] = str(value)
                break
    kind = flags.get("auth_type") or env.get(f"{prefix}AUTH_TYPE") or given.get("type") or ""
    out = Settings(**found, auth=Auth(kind=str(kind), **auth))
    out.headers = merged_headers(out.headers, env_headers(env, prefix))
    return out
