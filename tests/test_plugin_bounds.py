"""Plugins that talk too much, too late, or not at all."""

import sys
import time

import pytest

from statloom.sources import plugin
from statloom.sources.base import SourceError


def make(tmp_path, body):
    (tmp_path / "main.py").write_text("import json, sys, time, subprocess\n" + body)
    return plugin.PluginConnector(tmp_path, {"name": "p", "command": [sys.executable, "main.py"]})


def test_answers(tmp_path):
    p = make(tmp_path, "r = json.loads(sys.stdin.readline())\nsys.stderr.write('x' * 500000)\nprint('\\n' + json.dumps({'result': [r['params']['path'], 'é' * 100000]}))\nprint('more')\n")
    assert p.call("list_objects", path="a") == ["a", "é" * 100000]
    assert make(tmp_path, "print(json.dumps({'result': 1}))\n").call("describe") == 1  # it doesn't read the request
    with pytest.raises(SourceError, match="said no"):
        make(tmp_path, "print(json.dumps({'error': 'said no'}))\n").call("describe")
    for body in ("sys.stderr.write('trouble')\n", "print('{')\nsys.stderr.write('trouble')\n"):
        with pytest.raises(SourceError, match="no JSON: .*trouble"):
            make(tmp_path, body).call("describe")
    with pytest.raises(SourceError, match="cannot be started"):
        plugin.PluginConnector(tmp_path, {"name": "p", "command": ["/absent"]}).call("describe")


def test_too_much_is_not_held(tmp_path, monkeypatch):
    monkeypatch.setattr(plugin, "MOST_BYTES", 1 << 20)
    p = make(tmp_path, "while True:\n    sys.stdout.write('x' * 100000)\n")
    start = time.time()
    with pytest.raises(SourceError, match="too much"):
        p.call("load")
    assert time.time() - start < 30


def test_waiting_ends_though_a_child_holds_the_pipe(tmp_path, monkeypatch):
    monkeypatch.setitem(plugin.TIMEOUTS, "describe", 1)
    p = make(tmp_path, "subprocess.Popen([sys.executable, '-c', 'import time; time.sleep(20)'])\n")
    start = time.time()
    with pytest.raises(SourceError, match="did not answer"):
        p.call("describe")
    assert time.time() - start < 10
