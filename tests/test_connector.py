"""The connector against a host on this machine, and its parts by themselves."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from objectlog.sources import connector, mappers
from pyspark.sql import functions as F


def issue(k, updated):
    return {"id": f"I{k}", "number": k, "title": f"issue {k}", "state": "OPEN", "createdAt": "2024-01-01T00:00:00Z", "updatedAt": updated, "author": {"login": "ann"}}


ISSUES = [issue(k, f"2024-01-{k:02d}T00:00:00Z") for k in range(1, 8)]


class Host(BaseHTTPRequestHandler):
    seen, fail, nodes, nulls = [], [], None, True

    def log_message(self, *_):
        pass

    def answer(self, status, data, **headers):
        body = json.dumps(data).encode()
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        v = asked["variables"]
        Host.seen.append(v)
        if Host.fail:
            return self.answer(Host.fail.pop(), {"message": "no"})
        if "comments(" in asked["query"] and "issue(number" in asked["query"]:
            nodes = [{"id": f"C{v['number']}", "createdAt": "2024-01-02T00:00:00Z", "author": {"login": "bob"}}]
            return self.answer(200, {"data": {"repository": {"issue": {"comments": {"nodes": nodes, "pageInfo": {"hasNextPage": False}}}}}})
        at = int(v["cursor"] or 0)
        end = at + v["pageSize"]
        held = ISSUES if Host.nodes is None else Host.nodes
        end = min(end, len(held)) if Host.nodes is not None else end
        page = {"nodes": held[at:end] + [None] * Host.nulls, "pageInfo": {"hasNextPage": end < len(held), "endCursor": str(end)}}
        self.answer(200, {"data": {"repository": {"issues": page}, "rateLimit": {"cost": 1, "remaining": 5000, "resetAt": "2024-01-01T00:00:00Z"}}})

    def do_GET(self):
        url = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(url.query).items()}
        Host.seen.append(q)
        if url.path.endswith("/jobs"):
            return self.answer(200, {"jobs": [{"id": 9, "name": "build"}] if q["page"] == "1" else []})
        if "/commits/" in url.path:
            n = 100 if q["page"] == "1" else 30
            return self.answer(200, {"files": [{"filename": f"f{q['page']}-{k}", "status": "added"} for k in range(n)], "stats": {"total": 3}, "commit": {"verification": {"reason": "valid"}}})
        if url.path.endswith("/missing"):
            return self.answer(404, {})
        self.answer(200, {"workflow_runs": [{"id": 5, "name": "ci"}]} if q["page"] == "1" else {"workflow_runs": []}, X_RateLimit_Remaining="9", X_RateLimit_Reset="100")


@pytest.fixture(scope="module")
def host():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Host)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.fixture
def client(host):
    Host.seen.clear(), Host.fail.clear()
    return connector.Client("o", "r", host, host + "/graphql", limiter=connector.Limiter(sleep=lambda _: None), retry=connector.Retry(3, 0, 0))


def test_pages_of_a_connection(client):
    assert [n["number"] for _, n in connector.nodes(client, "issues", page_size=3)] == list(range(1, 8))
    assert [v["cursor"] for v in Host.seen] == [None, "3", "6"]
    Host.seen.clear()
    got = [n["number"] for _, n in connector.nodes(client, "issues", until="2024-01-04T00:00:00Z", page_size=3)]
    assert got == [1, 2, 3, 4] and len(Host.seen) == 2  # the rest is later, and isn't asked for
    assert [n for _, n in connector.nodes(client, "issue_comments", parents=[{"number": 3}])][0]["__issue_number"] == 3


def test_a_cursor_that_stands_still(client):
    client.graphql = lambda q, **v: {"repository": {"issues": {"nodes": [{"number": 1}], "pageInfo": {"hasNextPage": True, "endCursor": "x"}}}}
    assert len(list(connector.connection(client, connector.RESOURCES["issues"]))) == 2
    client.graphql = lambda q, **v: {"repository": {}}
    with pytest.raises(connector.FatalError):
        list(connector.connection(client, connector.RESOURCES["issues"]))


def test_pages_by_number(client):
    (_, run), = connector.workflow_runs(client, since="2024-01-02T00:00:00Z", until="2024-02-01T00:00:00Z")
    assert run["extracted_jobs"] == [{"id": 9, "name": "build"}] and Host.seen[0]["created"] == "2024-01-02..2024-02-01"
    (_, files), = connector.commit_files(client, ["abc"])
    assert len(files["files"]) == 130 and files["verification_reason"] == "valid" and files["stats"] == {"total": 3}
    assert client.limiter.left["core"] == (9, 100.0)


def test_errors_and_retries(client):
    Host.fail[:] = [502, 500]
    assert len(list(connector.nodes(client, "issues", page_size=50))) == 7
    Host.fail[:] = [500, 500, 500]
    with pytest.raises(connector.RetryableError):
        list(connector.nodes(client, "issues"))
    with pytest.raises(connector.FatalError):
        client.rest("/missing", page=1)
    tries = []

    def ask():
        tries.append(1)
        raise connector.QueryError("bad", "NOT_FOUND")

    with pytest.raises(connector.QueryError):
        connector.Retry(5, 0, 0).run(ask)
    assert len(tries) == 1 and [connector.Retry(9, 2, 20).pause(k) for k in (1, 2, 3, 4, 5)] == [2, 4, 8, 16, 20]


def test_limiter():
    slept = []
    limiter = connector.Limiter(clock=lambda: 1_000.0, sleep=slept.append)
    limiter.before("core")
    limiter.after(connector.Answer(200, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "1010"}, b""), "core")
    assert slept == []
    limiter.before("core")
    assert 5.5 <= slept[0] <= 16.5
    limiter.note({"cost": 2, "remaining": 99, "resetAt": "1970-01-01T00:17:00Z"})
    assert slept[1] == 22 and "graphql" not in limiter.left and limiter.cost == 2
    limiter.note({"remaining": 500, "resetAt": "1970-01-01T00:17:00Z"})
    limiter.after(connector.Answer(200, {"retry-after": "7"}, b""), "core")
    assert slept[2:] == [7.0] and limiter.waits == 3


def test_page_sizes_and_profiles():
    assert [connector.page_sizes(n)["pull_requests"] for n in (0, 499, 500, 1_000, 2_000)] == [50, 50, 40, 30, 20]
    assert [connector.page_sizes(reviews=n)["pr_reviews"] for n in (199, 200, 1_000)] == [30, 20, 10] and connector.page_sizes(discussions=500)["discussions"] == 20
    low = connector.page_sizes(points=999)
    assert (low["pr_reviews"], low["pr_comments"], low["pr_timeline"], low["discussions"]) == (10, 30, 30, 20)
    assert "pr_threads" not in connector.resources() and "pr_threads" in connector.resources("complete") and "pr_reviews" not in connector.resources("minimal")
    assert len(connector.RESOURCES) + 1 == 18 and all(r.query.count("{") == r.query.count("}") for r in connector.RESOURCES.values()) and connector.REPOSITORY.count("{") == connector.REPOSITORY.count("}")


def test_windows_agree(spark):
    """Reading with early ends and filtering what has landed keep the same nodes."""
    day = lambda k: f"2024-01-{k:02d}T00:00:00Z"
    times = {"releases": [("createdAt",)], "deployments": [("createdAt",)], "pull_requests": [("createdAt", "updatedAt")]}
    for name, (columns,) in times.items():
        r = connector.RESOURCES[name]
        made = [{"number": k, **{c: day(k + 3 * i) for i, c in enumerate(columns)}} for k in range(1, 20)] + [{"number": 99}]
        order = made if r.window.ascending else made[::-1]
        a, b, kept = connector.moment(day(5)), connector.moment(day(11)), []
        for n in order:
            if (place := r.window.place(n, a, b)) == "end":
                break
            kept += [n["number"]] * (place == "in")
        df = spark.createDataFrame([("x", r.kind, json.dumps(n)) for n in made], "repo string, kind string, node string")
        got = [json.loads(x.node)["number"] for x in connector.in_window(df, day(5), day(11)).collect()]
        assert sorted(set(kept) - {99}) == sorted(set(got) - {99}) and 99 in got


def test_data_source(spark, host, tmp_path):
    Host.seen.clear(), Host.fail.clear()
    connector.register(spark)
    read = spark.read.format("host_nodes").options(repository="o/r", repo="repo1", rest=host, graphql=host + "/graphql", page_size="3")
    got = read.option("resources", "issues,workflow_runs").load()
    assert {(r.kind, r["n"]) for r in got.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {("issue", 7), ("workflow_run", 1)}
    talk = read.options(resources="issue_comments", parents=json.dumps([{"number": k} for k in range(1, 5)]), parents_per_part="2").load()
    assert talk.rdd.getNumPartitions() == 2 and talk.count() == 4
    log = mappers.assemble(got.unionByName(talk))
    assert {r.otype for r in log.objects.select("otype").distinct().collect()} >= {"Issue", "Comment", "User", "WorkflowRun"}
    (tmp_path / "page.json").write_text(json.dumps({"data": {"repository": {"issues": {"nodes": [*ISSUES[:2], None]}}}}) + "\n")
    assert connector.landed(spark, str(tmp_path / "page.json"), "issues", "repo1").count() == 2


def test_overflow_and_profile_of_landed_nodes(spark):
    said = lambda total, *nodes: {"totalCount": total, "nodes": list(nodes)}
    made = [
        ("discussion", {"number": 1, "id": "D1", "comments": said(3, {"id": "c", "replies": said(2, {"id": "r"})}), "labels": said(1, {"id": "l"})}),
        ("discussion", {"number": 2, "comments": said(1, {"id": "d", "replies": said(0)})}),
        ("review_thread", {}), ("issue", {"number": 5, "id": "I5", "labels": said(60, *[{"id": k} for k in range(50)])}), ("deployment", {"id": "P", "statuses": said(2, {})}),
    ]
    df = spark.createDataFrame([("x", k, json.dumps(n)) for k, n in made], "repo string, kind string, node string")
    found = {(r.kind, r.id, r.number, r.list, r.total, r.embedded) for r in connector.overflowing(df).collect()}
    assert found == {("discussion", "D1", 1, "comments", 3, 1), ("discussion", "c", 1, "comments.replies", 2, 1), ("issue", "I5", 5, "labels", 60, 50), ("deployment", "P", None, "statuses", 2, 1)}
    df = df.filter("kind <> 'deployment'")
    assert {r.kind for r in connector.of_profile(df, "standard").collect()} == {"discussion", "issue"} and connector.of_profile(df, "complete").count() == 4


class Shelf:
    """A host that holds one node with long lists, and gives pages of them by cursor."""

    def __init__(self, lists, first):
        self.lists, self.first, self.asked = lists, first, []

    def page(self, key, cursor, size):
        at = int(cursor or 0)
        rows = self.lists[key]
        return {"totalCount": len(rows), "nodes": rows[at : at + size], "pageInfo": {"hasNextPage": at + size < len(rows), "endCursor": str(at + size)}}

    def graphql(self, query, **v):
        assert query.count("{") == query.count("}")
        if "id" not in v:  # the first page of everything
            return {"repository": self.first(self)}
        name = query.split("... on ")[1].split("{ ")[1].split("(")[0]
        self.asked.append((v["id"], name, v["cursor"]))
        page = self.page((v["id"], name), v["cursor"], v["pageSize"])
        return {"node": {name: page}}


def last_page(*nodes):
    return {"nodes": list(nodes), "pageInfo": {"hasNextPage": False}}


def test_lists_inside_nodes_are_read_whole():
    asset = [{"downloadCount": k} for k in range(350)]
    shelf = Shelf({("R", "releaseAssets"): asset}, lambda s: {"releases": last_page({"id": "R", "createdAt": "2024-01-01T00:00:00Z", "releaseAssets": s.page(("R", "releaseAssets"), None, 100)})})
    ((kind, node),) = connector.nodes(shelf, "releases")
    assert kind == "release" and sum(a["downloadCount"] for a in node["releaseAssets"]["nodes"]) == sum(range(350)) and [c for *_, c in shelf.asked] == ["100", "200", "300"]

    talk = {("D", "labels"): [{"id": f"l{k}"} for k in range(45)], ("D", "comments"): []}
    for k in range(120):
        talk[(f"c{k}", "replies")] = [{"id": f"r{k}-{j}"} for j in range(130 if k in (3, 119) else 1)]
    shelf = Shelf(talk, None)
    talk[("D", "comments")] = [{"id": f"c{k}", "replies": shelf.page((f"c{k}", "replies"), None, 50)} for k in range(120)]
    shelf.first = lambda s: {"discussions": last_page({"id": "D", "number": 1, "labels": s.page(("D", "labels"), None, 20), "comments": s.page(("D", "comments"), None, 50)})}
    ((_, node),) = connector.nodes(shelf, "discussions")
    assert len(node["labels"]["nodes"]) == 45 and [c["id"] for c in node["comments"]["nodes"]] == [f"c{k}" for k in range(120)]
    assert [len(c["replies"]["nodes"]) for c in node["comments"]["nodes"]] == [130 if k in (3, 119) else 1 for k in range(120)]


def test_every_list_goes_on_by_its_id():
    """Each declared list of each kind is asked for in its query, with its count and its cursor, and read to its end."""
    of_kind = {"issue": "issues", "pull_request": "pull_requests", "review": "pr_reviews", "review_thread": "pr_threads", "commit": "commits", "deployment": "deployments", "release": "releases", "discussion": "discussions", "discussion_comment": "discussion_comments"}
    assert set(of_kind) == set(connector.NESTED)
    for kind, lists in connector.NESTED.items():
        query = connector.RESOURCES[of_kind[kind]].query
        assert query.count("(first: ") == query.count("pageInfo { hasNextPage endCursor }") + query.count("(first: 1)")
        for name in lists.of:
            assert f"{name}(first: " in query and " id " in f" {connector.RESOURCES[of_kind[kind]].fields} "
            shelf = Shelf({("N", name): [{"id": str(k), "n": k} for k in range(230)]}, None)
            node = connector.whole(shelf, {"id": "N", name: shelf.page(("N", name), None, 20)}, lists)
            assert [n["n"] for n in node[name]["nodes"]] == list(range(230)) and len(shelf.asked) == 3
    off = {"id": "V", "comments": {"totalCount": 9, "pageInfo": {"hasNextPage": True, "endCursor": "5"}}}
    assert connector.whole(Shelf({}, None), off, connector.NESTED["review"]) == off  # a profile has left the comments out
    with pytest.raises(connector.FatalError):
        gone = Shelf({}, None)
        gone.graphql = lambda q, **v: {"node": None}
        connector.whole(gone, {"id": "R", "releaseAssets": {"nodes": [], "pageInfo": {"hasNextPage": True, "endCursor": "5"}}}, connector.NESTED["release"])


def test_a_stream_goes_on_where_it_was_stopped(spark, host, tmp_path, monkeypatch):
    """Nodes come once each, over stops, restarts, a batch that was planned but not done, and nodes that are added later."""
    Host.seen.clear(), Host.fail.clear()
    monkeypatch.setattr(Host, "nulls", False)
    monkeypatch.setattr(Host, "nodes", [issue(k, "2024-01-05T00:00:00Z") for k in range(1, 12)])
    connector.register(spark)
    read = lambda: spark.readStream.format("host_nodes").options(repository="o/r", repo="repo1", rest=host, graphql=host + "/graphql", resources="issues", page_size="3", pages_per_batch="2").load()
    out, kept = str(tmp_path / "out"), str(tmp_path / "kept")

    def run():
        q = read().writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).start()
        q.processAllAvailable()
        q.stop()
        return sorted(json.loads(r.node)["number"] for r in spark.read.parquet(out).collect())

    assert run() == list(range(1, 12))
    assert len([v for v in Host.seen if v["pageSize"] == 3]) >= 4
    Host.nodes.extend(issue(k, "2024-01-06T00:00:00Z") for k in range(12, 16))
    assert run() == list(range(1, 16)) and run() == list(range(1, 16))
    reader = connector.NodeStreamReader({"repository": "o/r", "repo": "x", "rest": host, "graphql": host + "/graphql", "resources": "issues", "page_size": "4", "pages_per_batch": "1"})
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end == {"issues": {"after": "4", "nodes": 4}} and reader.latestOffset()["issues"]["nodes"] == 8
    again = connector.NodeStreamReader(reader.options)
    pages = again.partitions(start, {"issues": {"after": "10", "nodes": 10}})
    assert [(p.after, p.first) for p in pages] == [("", 4), ("4", 4), ("8", 2)]
    assert [json.loads(n)["number"] for p in pages for *_, n in again.read(p)] == list(range(1, 11))
    with pytest.raises(ValueError):
        connector.NodeStreamReader({"resources": "commits"})
    assert "$withStatusChecks" not in connector.RESOURCES["pull_requests"].steps and "$since:" in connector.RESOURCES["issues"].steps
