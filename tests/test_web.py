"""Lookups as a data source, against a local server."""

import collections
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from probatum.sources import web

ASKED = "provider string, key string, url string, outcome string"


@pytest.fixture
def server():
    seen = collections.Counter()

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            seen[(self.command, self.path)] += 1
            code = 404 if "gone" in self.path else 405 if self.command == "HEAD" and "nohead" in self.path else 418 if "odd" in self.path else 200
            self.send_response(code)
            body = f"body of {self.path}".encode() if self.command == "GET" and code == 200 else b""
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_HEAD = answer

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_each_url_is_asked_once_and_never_again(spark, tmp_path, server):
    base, seen = server
    rows = [("a", f"k{i}", f"{base}/x/{i % 20}", "o") for i in range(60)] + [("a", "g", f"{base}/gone", "o"), ("b", "o", f"{base}/odd", "o"), ("b", "none", None, "o"), ("b", "empty", "", "o"), ("b", "bad", "no url at all", "o")]
    requests, cache = spark.createDataFrame(rows, ASKED).repartition(4), str(tmp_path / "cache")
    for _ in range(2):
        got = {r["key"]: (r["outcome"], r["body"]) for r in web.responses(requests, cache, rate=0, readers=3).collect()}
        assert len(got) == 65 and got["k7"] == got["k27"] == ("ok", "body of /x/7")
        assert got["g"] == ("absent", None) and {got[k][0] for k in ("o", "none", "empty", "bad")} == {"error"}
    assert {n for (_, p), n in seen.items() if p.startswith("/x/")} == {1} and seen[("GET", "/gone")] == 1
    assert seen[("GET", "/odd")] == 2  # a lookup that failed is made again by another run


def test_probes_ask_with_get_where_head_is_refused(spark, tmp_path, server):
    base, seen = server
    urls = spark.createDataFrame([(f"{base}/nohead",), (f"{base}/gone",), (f"{base}/a",), (f"{base}/a",), ("http://127.0.0.1:1/x",), ("",)], "url string")
    got = {r["url"].rsplit("/", 1)[1]: (r["http_status"], r["error"] is None) for r in web.probes(urls, str(tmp_path / "cache"), rate=0).collect()}
    assert got == {"nohead": (200, True), "gone": (404, True), "a": (200, True), "x": (None, False)}
    assert seen[("HEAD", "/a")] == 1


def test_a_task_that_dies_asks_nothing_twice(spark, tmp_path, server):
    base, seen = server
    path = web.laid_out(spark.createDataFrame([(f"{base}/d/{i}",) for i in range(10)], "url string"))
    options = {"requests": path, "cache": str(tmp_path / "cache"), "rate": "0"}
    (part,) = web.LookupReader(options).partitions()
    dying = web.LookupReader(options).read(part)
    first = [next(dying) for _ in range(4)]
    dying.close()
    again = list(web.LookupReader(options).read(part))
    assert len(again) == 10 and again[:4] == first and set(seen.values()) == {1}


def test_the_first_answer_stays(tmp_path):
    answers = web.Answers(str(tmp_path), "get")
    assert answers.get("u") is None
    assert answers.put("u", ["ok", "one", None]) == ["ok", "one", None] == answers.put("u", ["ok", "two", None]) == answers.get("u")


def test_hosts_are_partitions_of_their_own(spark):
    urls = [f"http://h{i % 3}.example:80/p{i}" for i in range(30)] + ["https://user@H1.example:80/q", "mailto:x"]
    path = web.laid_out(spark.createDataFrame([(u,) for u in urls], "url string"), readers=2)
    parts = web.LookupReader({"requests": path, "cache": "x"}).partitions()
    hosts = collections.Counter(p.path.split("host=")[1].split("/")[0] for p in parts)
    assert sorted(bytes.fromhex(h).decode() for h in hosts if h != "none") == ["h0.example:80", "h1.example:80", "h2.example:80"] and hosts["none"] == 1
    assert all(n <= 2 for n in hosts.values())


def test_a_reader_keeps_its_pace():
    now, waits = [100.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    pace = web.Pace(4.0, lambda: now[0], sleep)
    for _ in range(3):
        pace.wait()
    now[0] += 10
    pace.wait()
    assert waits == [0.25, 0.25]
    assert web.Pace(0.0).gap == 0.0
