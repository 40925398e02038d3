import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from logtide.functions.offsets import NEWEST
from logtide.sources import chunks, remote


class Store:
    """Chunks of two events each; ``trouble`` holds status codes to answer first."""

    def __init__(self):
        self.events, self.trouble, self.tokens = [], [], []

    def add(self, *values):
        self.events += values

    def answer(self, offset):
        at = 0 if offset == "-1" else int(offset[1:])
        part = self.events[at : at + 2]
        return part, f"t{at + len(part)}", at + len(part) >= len(self.events)


@pytest.fixture
def served():
    store = Store()

    class Handler(BaseHTTPRequestHandler):
        def reply(self, code, headers=(), body=b""):
            self.send_response(code)
            for k, v in (*headers, ("Content-Length", str(len(body)))):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def do_HEAD(self):
            self.reply(200, [("Stream-Next-Offset", f"t{len(store.events)}")])

        def do_GET(self):
            if store.trouble:
                return self.reply(store.trouble.pop(0))
            offset = parse_qs(urlsplit(self.path).query)["offset"][0]
            store.tokens.append(offset)
            part, to, done = store.answer(offset)
            body = "[" + ",".join(json.dumps({"type": "t", "data": {"n": e}}) if e is not None else "7" for e in part) + "]"
            self.reply(200, [("Stream-Next-Offset", to), *([("Stream-Up-To-Date", "true")] if done else [])], body.encode())

        def log_message(self, *args): ...

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield store, f"http://127.0.0.1:{server.server_port}/s"
    server.shutdown()


def values(df):
    return [json.loads(r["data"])["n"] for r in df.collect()]


def test_scan_goes_on_behind_chunks_without_events(spark, served):
    store, url = served
    store.add(1, 2, None, None, 3)
    got = remote.read_chunks(spark, url)
    assert [(r["seq"], r["chunk_start"], r["next_offset"], r["up_to_date"]) for r in got.orderBy("seq").collect()] == [(0, "", "t2", False), (1, "t2", "t4", False), (2, "t4", "t5", True)]
    assert sorted(values(chunks.decode_chunks(got))) == [1, 2, 3] and chunks.rejected(got).count() == 2
    assert chunks.next_offset(got).first()[0] == "t5" and chunks.next_offset(got.drop("seq")).first()[0] == "t5"
    assert sorted((r["offset"], json.loads(r["data"])["n"]) for r in remote.read_events(spark, url, start="t1").collect()) == [("t3", 2), ("t5", 3)]
    assert remote.read_events(spark, url, start=NEWEST).count() == 0


def test_empty_stream(spark, served):
    _, url = served
    got = remote.read_chunks(spark, url)
    assert got.count() == 1 and chunks.decode_chunks(got).count() == 0 and chunks.next_offset(got).first()[0] == "t0"


def test_retries_what_may_pass(served):
    store, url = served
    store.add(1)
    client = remote.Client({"url": url, "pause": "0"})
    store.trouble = [503, 429]
    assert len(list(client.chunks(""))) == 1
    store.trouble = [500, 500, 500]
    with pytest.raises(remote.RemoteError):
        list(client.chunks(""))
    store.trouble = [410]
    with pytest.raises(remote.RemoteError, match="410"):
        list(client.chunks(""))
    assert store.trouble == []


def test_stream_resumes_where_it_stopped(spark, served, tmp_path):
    store, url = served
    store.add(1, 2, 3)
    seen = []

    def run():
        rows = remote.tail_chunks(spark, url, chunks_per_trigger=1)
        query = rows.writeStream.foreachBatch(lambda df, _: seen.extend(values(chunks.decode_chunks(df).orderBy("chunk_start", "member")))).option("checkpointLocation", f"file://{tmp_path}/cp").start()
        query.processAllAvailable()
        return query

    query = run()
    assert seen == [1, 2, 3]
    store.add(4)
    query.processAllAvailable()
    query.stop()
    assert seen == [1, 2, 3, 4]
    store.add(5, 6, 7)
    run().stop()
    assert seen == [1, 2, 3, 4, 5, 6, 7]
