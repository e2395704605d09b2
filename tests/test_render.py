import json

import pytest

from widecairn.config import Config
from widecairn.render import render
from widecairn.session import Response

R = Response(data=[{"a": 1, "b": None}, {"a": 22, "b": "x,y"}], rows=2, columns=["a", "b"])


def test_formats():
    assert render(R, "csv") == 'a,b\n1,\n22,"x,y"\n'
    assert json.loads(render(R, "json")) == R.data
    assert render(R, "pretty").splitlines()[3] == "| 1  | NULL |"
    assert "*** row 2 ***" in render(R, "vertical") and "b: x,y" in render(R, "vertical")
    assert render(Response(2, "no")) == "ERROR 2: no"
    assert render(Response(rows=3)) == "OK, 3 rows affected"
    assert "0 rows" in render(Response(data=[], columns=["a"]))
    with pytest.raises(ValueError):
        render(R, "xml")


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("http_port: 9000  # comment\nhost: '0.0.0.0'\n")
    c = Config.load(str(f), slow_query_ms=5)
    assert (c.http_port, c.host, c.slow_query_ms) == (9000, "0.0.0.0", 5)
    f.write_text("nope: 1")
    with pytest.raises(ValueError):
        Config.load(str(f))
    with pytest.raises(ValueError):
        Config(http_port=-1)


def test_sectioned_settings(tmp_path):
    f = tmp_path / "server.yaml"
    f.write_text("# addresses\nserver:\n  tcp_addr: \"127.0.0.1:9000\"  # own protocol\n  http_addr: \":8081\"\n  pg_addr: \"\"\n  slow_query_threshold_ms: 5\nstorage:\n  data_dir: \"./data\"\n  max_memtable_size: 67108864\nscheduler:\n  enabled: false\n  flush_interval: 5s\n  compact_interval: 1m30s\n  wal_clean_interval: 500ms\n")
    c = Config.load(str(f), root="given")
    assert c.address("tcp") == ("127.0.0.1", 9000) and c.address("http") == ("0.0.0.0", 8081) and c.address("pg") is None
    assert (c.slow_query_ms, c.scheduler, c.compact_seconds, c.clean_seconds, c.root) == (5, False, 90, 0.5, "given")
    f.write_text("server:\n  port: 1\n")
    with pytest.raises(ValueError, match="server.port"):
        Config.load(str(f))
    f.write_text('{"storage": {"data_dir": "x"}, "group_commit_ms": 0}')
    assert Config.load(str(f)).root == "x" and Config.load(str(f)).group_commit_ms == 0


def test_histogram():
    from widecairn.session import Histogram

    h = Histogram()
    for x in (0.001, 0.005, 0.3, 99):
        h.add(x)
    got = h.lines("t")
    assert got['t_bucket{le="0.005"}'] == 2 and got['t_bucket{le="0.5"}'] == 3 and got['t_bucket{le="10"}'] == 3 and got['t_bucket{le="+Inf"}'] == got["t_count"] == 4
