from __future__ import annotations

import json
import logging

import pytest

from weftspan import cli, logs
from weftspan import settings as S
from weftspan.settings import Auth, Settings, SettingsError


def test_layers():
    file = S.parse_yaml("concurrency: 3\nrequest_delay: 0.5\nrequest_timeout: 1m30s\nseed_urls:\n  - https://a/\n  - https://b/\nlimit: 7 # pages\nauth:\n  type: bearer\n  bearer:\n    token_env: TOK\n")
    got = S.load(file, {"WEFT_CONCURRENCY": "4", "WEFT_LIMIT": "8", "TOK": "t"}, {"limit": 9, "user_agent": None})
    assert (got.concurrency, got.request_delay, got.request_timeout, got.limit, got.seed_urls) == (4, 0.5, 90, 9, ["https://a/", "https://b/"])
    got.check({"TOK": "t"})
    with pytest.raises(SettingsError):
        got.check({})
    assert S.load({}, {}).user_agent.startswith("weftspan/")


@pytest.mark.parametrize("bad", [{"concurrency": 0}, {"request_timeout": 0}, {"warehouse": ""}, {"headers": ["x"]}, {"headers": [": v"]}, {"headers": ["a:"]}, {"headers": ["HOST: x"]}, {"headers": ["Content-Length: 1"]}, {"auth": Auth(kind="basic", username="u")}, {"auth": Auth(username="u", token="t")}, {"auth": Auth(kind="odd")}, {"auth": Auth(kind="api-key", header="h")}])
def test_checks(bad):
    with pytest.raises(SettingsError):
        Settings(**bad).check({})


def test_least_delay():
    assert Settings(request_delay=0).check().request_delay == 0.1 and Settings(request_delay=2).check().request_delay == 2


def test_env_wins_over_plain_credentials():
    a = Auth(kind="basic", username="u", password="p", password_env="P")
    assert a.get("password", {"P": "env"}) == "env" and a.get("username", {}) == "u"
    with pytest.raises(SettingsError):
        a.check({})


def test_headers():
    assert S.env_headers({"WEFT_HEADER_X_CUSTOM": "v", "WEFT_HEADER_ACCEPT": "a", "OTHER": "o", "WEFT_HEADER_": "n"}) == ["Accept: a", "X-Custom: v"]
    assert S.merged_headers(["Accept: 1", "B: 2"], ["Accept: 3", "C: 4"]) == ["Accept: 3", "B: 2", "C: 4"]
    assert S.headers_map(["A: 1", "bad", ":x", "B:"]) == {"A": "1"}


def test_durations():
    assert [S.seconds(x) for x in ("30s", "500ms", "1h", "2", 3)] == [30, 0.5, 3600, 2, 3]
    with pytest.raises(SettingsError):
        S.seconds("soon")


def test_yaml_round_trip():
    s = Settings(seed_urls=["https://a/#x"], headers=["A: b"], limit=3, request_delay=0.25, ignore_robots_txt=True, log_file="")
    text = S.dump_yaml(s.shown())
    again = S.load({k: v for k, v in S.parse_yaml(text).items() if k != "auth"}, {})
    assert again == s


def test_secrets_are_not_shown(capsys, monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "weftspan.yml").write_text("concurrency: 5\n")
    assert cli.main(["--show-config", "--auth-type", "basic", "--auth-username", "name", "--auth-password", "hidden", "https://a/"]) == 0
    out = capsys.readouterr().out
    assert "hidden" not in out and "name" not in out.replace("username", "") and "concurrency: 5" in out and "https://a/" in out


def test_cli_errors(capsys, monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    assert cli.main([]) == 1
    assert cli.main(["https://a/", "-H", "bad"]) == 2
    assert cli.main(["https://a/", "--timeout", "soon"]) == 2


def test_logs(tmp_path):
    assert [logs.level(x) for x in ("debug", "WARN", "warning", "error", "odd")] == [logging.DEBUG, logging.WARNING, logging.WARNING, logging.ERROR, logging.INFO]
    file = tmp_path / "x.log"
    log = logs.logger("info", str(file), max_mb=0.0005, backups=2, console=False)
    for k in range(40):
        log.info("hello", extra={"k": k, "é": "ü"})
    log.debug("not this")
    lines = [json.loads(x) for f in sorted(tmp_path.glob("x.log*")) for x in f.read_text().splitlines()]
    assert len(list(tmp_path.glob("x.log*"))) == 3 and all(x["msg"] == "hello" and x["level"] == "INFO" for x in lines)
    logs.logger(console=False)
