"""A connector to a code host's REST and GraphQL interfaces: one row for each node, as the mappers read them.

Every resource is a declaration: where its connection lies in the answer, which fields a node has, and how a window of
time applies to it. From that come the query text, the pages, and the place where reading may end early. Landed answers
are read by `landed`; `NodeSource` reads live ones as a Spark data source, one partition for each resource or run of
parents, so that pages are fetched by executors and nothing goes through the driver.
"""

from __future__ import annotations

import json
import random
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class ConnectorError(Exception):
    """Anything that goes wrong between here and the host."""


class FatalError(ConnectorError):
    """Asking again won't help: no right to ask, or nothing there."""


class RetryableError(ConnectorError):
    """Asking again may help: the host is busy, down, or wants a pause."""


class QueryError(ConnectorError):
    """The host understood the request and reports an error of its own."""

    def __init__(self, message: str | None, kind: str | None = None, path: list | None = None):
        super().__init__(message or "query failed")
        self.kind, self.path = kind, path

    @property
    def retryable(self) -> bool:
        return self.kind in RETRYABLE_KINDS


#: Kinds of query errors that pass, and statuses that stay.
RETRYABLE_KINDS = ("RATE_LIMITED", "INTERNAL", "SERVICE_UNAVAILABLE", "TIMEOUT")
FATAL_STATUS = {401: "not signed in", 403: "no right to this", 404: "not found"}


class Answer(NamedTuple):
    status: int
    headers: dict[str, str]
    body: bytes


def over_http(method: str, url: str, headers: dict[str, str], body: bytes | None = None, timeout: float = 30) -> Answer:
    """One request by the standard library; what keeps it from an answer may pass."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=timeout) as got:
            return Answer(got.status, {k.lower(): v for k, v in got.headers.items()}, got.read())
    except urllib.error.HTTPError as e:
        return Answer(e.code, {k.lower(): v for k, v in e.headers.items()}, e.read())
    except OSError as e:
        raise RetryableError(str(e)) from e


def moment(text: str | None) -> datetime | None:
    """An ISO time; without an offset it is UTC."""
    if not text:
        return None
    t = datetime.fromisoformat(text)
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


@dataclass
class Limiter:
    """Waits when the host's budget is spent, and before that when few points are left."""

    low_water: int = 100
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    left: dict[str, tuple[int, float]] = field(default_factory=dict)  # budget: points left, when they are renewed
    waits: int = 0
    cost: int = 0

    def _wait(self, seconds: float) -> None:
        self.waits += 1
        self.sleep(seconds)

    def before(self, budget: str) -> None:
        """Nothing left: sleep until the budget is renewed, spread so that many readers don't return at once."""
        points, renewed = self.left.get(budget, (1, 0.0))
        if points <= 0:
            self._wait((max(0.0, renewed - self.clock()) + 1) * random.uniform(0.5, 1.5))

    def after(self, answer: Answer, budget: str) -> None:
        """Take note of an answer's headers."""
        points, renewed = answer.headers.get("x-ratelimit-remaining", ""), answer.headers.get("x-ratelimit-reset", "")
        if points.isdigit() and renewed.isdigit():
            self.left[budget] = int(points), float(renewed)
        if (pause := answer.headers.get("retry-after", "")).isdigit():
            self._wait(float(pause))

    def note(self, said: dict | None, budget: str = "graphql") -> None:
        """Take note of the points that a query's answer reports; few are left: sleep until they are renewed."""
        if not said or said.get("remaining") is None:
            return
        self.cost, renewed = said.get("cost", 1), moment(said.get("resetAt"))
        self.left[budget] = int(said["remaining"]), renewed.timestamp() if renewed else 0.0
        if renewed and said["remaining"] < self.low_water:
            self._wait(max(0.0, renewed.timestamp() - self.clock()) + 2)
            del self.left[budget]


@dataclass(frozen=True)
class Retry:
    """Up to ``times`` tries, with pauses that double from ``least`` to ``most`` seconds."""

    times: int = 5
    least: float = 1.0
    most: float = 60.0

    def pause(self, attempt: int) -> float:
        return min(self.most, self.least * 2 ** (attempt - 1))

    def run(self, ask: Callable[[], Any], sleep: Callable[[float], None] = time.sleep) -> Any:
        """The answer, or the last error. Fatal errors, and query errors that stay, are raised at once."""
        for attempt in range(1, self.times + 1):
            try:
                return ask()
            except FatalError:
                raise
            except Exception as e:
                if attempt == self.times or (isinstance(e, QueryError) and not e.retryable):
                    raise
                sleep(self.pause(attempt))
        raise ValueError("a retry needs one try at least")


@dataclass
class Client:
    """Requests for one repository."""

    owner: str
    name: str
    rest_url: str
    graphql_url: str
    token: str = ""
    limiter: Limiter = field(default_factory=Limiter)
    retry: Retry = field(default_factory=Retry)
    transport: Callable[..., Answer] = over_http

    def _ask(self, budget: str, method: str, url: str, body: bytes | None = None) -> Any:
        def once() -> Any:
            self.limiter.before(budget)
            got = self.transport(method, url, {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {}), body)
            self.limiter.after(got, budget)
            if got.status in FATAL_STATUS:
                raise FatalError(f"{FATAL_STATUS[got.status]} ({got.status}): {url}")
            if got.status == 429 or got.status >= 500:
                raise RetryableError(f"status {got.status}: {url}")
            if got.status >= 400:
                raise FatalError(f"status {got.status}: {url}")
            data = json.loads(got.body)
            if budget != "graphql":
                return data
            if data.get("errors"):
                first = data["errors"][0]
                raise QueryError(first.get("message"), first.get("type"), first.get("path"))
            self.limiter.note(data["data"].get("rateLimit"))
            return data["data"]

        return self.retry.run(once, self.limiter.sleep)

    def rest(self, path: str, **params: Any) -> Any:
        """The answer to a GET."""
        return self._ask("core", "GET", f"{self.rest_url}{path}" + (f"?{urllib.parse.urlencode(params)}" if params else ""))

    def pages(self, path: str, per_page: int = 100, inside: str | None = None, **params: Any) -> Iterator[list]:
        """Pages by number, until one is empty or not full; ``inside`` names the list in an answer."""
        page = 1
        while rows := (lambda got: got.get(inside, []) if inside else got)(self.rest(path, per_page=per_page, page=page, **params)):
            yield rows
            if len(rows) < per_page:
                return
            page += 1

    def graphql(self, query: str, **variables: Any) -> dict:
        """The data of a query's answer."""
        return self._ask("graphql", "POST", self.graphql_url, json.dumps({"query": query, "variables": {"owner": self.owner, "repo": self.name} | variables}).encode())


@dataclass(frozen=True)
class Window:
    """How a window of time applies to a resource's nodes: the times that count, in which order pages bring the first of them,
    and which bounds the host itself keeps."""

    times: tuple[str, ...]
    ascending: bool
    kept_since: bool = False

    def place(self, node: dict, since: datetime | None, until: datetime | None) -> str:
        """`in` the window, `out` of it, or `end`: out, and so are all that follow."""
        at = [t for t in (moment(node.get(c)) for c in self.times) if t]
        if at and until and min(at) > until:  # all of them
            return "end" if self.ascending else "out"
        if at and since and not self.kept_since and max(at) < since:
            return "out" if self.ascending else "end"
        return "in"

    def filter(self, since: str | None, until: str | None):
        """The same as a condition on landed nodes (column node)."""
        at = [F.try_to_timestamp(F.get_json_object("node", f"$.{c}")) for c in self.times]
        first, last = (F.least(*at), F.greatest(*at)) if len(at) > 1 else (at[0], at[0])
        keep = F.lit(True)
        if until:
            keep = keep & ~F.coalesce(first > F.lit(moment(until)), F.lit(False))
        if since:
            keep = keep & ~F.coalesce(last < F.lit(moment(since)), F.lit(False))
        return keep


_WHO = "{ login __typename }"
_SUM = "{ totalCount }"
_TALK = f"id bodyText url createdAt updatedAt lastEditedAt isMinimized minimizedReason authorAssociation author {_WHO} reactions {_SUM}"
_PAGE = "totalCount pageInfo { hasNextPage endCursor }"


def _list(name: str, first: int, fields: str, include: str = "") -> str:
    """A list inside a node: its first page, and what tells whether there are more (see `whole`)."""
    return f"{name}(first: {first}) {{ {_PAGE} nodes{include} {{ {fields} }} }}"


_PEOPLE, _LABELS, _NUMBER, _OID = "login", "id name", "number", "commit { oid }"
_SUITE, _STATUS, _ASSET = "status conclusion workflowRun { databaseId }", "state createdAt description environmentUrl logUrl", "downloadCount"
_LINE = f"{_TALK.replace('lastEditedAt ', '')} path line position diffHunk replyTo {{ id }}"
_MARK = "id path createdAt originalLine outdated replyTo { id }"
_REPLIED = f"{_TALK} isAnswer {_list('replies', 50, _TALK)}"


@dataclass(frozen=True)
class Lists:
    """What lists the nodes of a host's type hold: the fields of their nodes, and the type of these if they hold lists too."""

    type: str
    of: dict[str, str]
    inner: dict[str, Lists] = field(default_factory=dict)


#: The lists inside the nodes of each kind.
NESTED = {
    "issue": Lists("Issue", {"assignees": _PEOPLE, "labels": _LABELS}),
    "pull_request": Lists("PullRequest", {"assignees": _PEOPLE, "labels": _LABELS, "commits": _OID}),
    "review": Lists("PullRequestReview", {"comments": _LINE}),
    "review_thread": Lists("PullRequestReviewThread", {"comments": _MARK}),
    "commit": Lists("Commit", {"associatedPullRequests": _NUMBER, "checkSuites": _SUITE}),
    "deployment": Lists("Deployment", {"statuses": _STATUS}),
    "release": Lists("Release", {"releaseAssets": _ASSET}),
    "discussion": Lists("Discussion", {"labels": "id", "comments": _REPLIED}, {"comments": Lists("DiscussionComment", {"replies": _TALK})}),
    "discussion_comment": Lists("DiscussionComment", {"replies": _TALK}),
}


def whole(client: Client, node: dict, lists: Lists | None) -> dict:
    """A node whose lists hold all of their nodes: what the first page left out is asked for by the node's id, page by page. Lists
    that a profile leaves out stay out."""
    for name, fields in (lists.of if lists else {}).items():
        held = node.get(name)
        if not held or "nodes" not in held:
            continue
        query = f"query($id: ID!, $cursor: String, $pageSize: Int!) {{ node(id: $id) {{ ... on {lists.type} {{ {name}(first: $pageSize, after: $cursor) {{ {_PAGE} nodes {{ {fields} }} }} }} }} rateLimit {{ cost remaining resetAt }} }}"
        said, seen = held.get("pageInfo") or {}, None
        while said.get("hasNextPage") and said.get("endCursor") and said["endCursor"] != seen and node.get("id"):
            seen = said["endCursor"]
            got = (client.graphql(query, id=node["id"], cursor=seen, pageSize=100).get("node") or {}).get(name)
            if got is None:
                raise FatalError(f"the answer has no {name!r} of {node['id']}")
            held = {**held, "nodes": [*held["nodes"], *(got.get("nodes") or [])], "pageInfo": got.get("pageInfo") or {}}
            said = held["pageInfo"]
        if name in lists.inner:
            held = {**held, "nodes": [whole(client, n, lists.inner[name]) for n in held["nodes"] if n]}
        node = {**node, name: held}
    return node


_ABOUT = (
    f"id number title state url locked activeLockReason authorAssociation createdAt updatedAt closedAt bodyText author {_WHO} milestone {{ id }} reactionGroups {{ content reactors {_SUM} }} reactions {_SUM} participants {_SUM} "
    f"comments {_SUM} timelineItems {_SUM} {_list('assignees', 20, _PEOPLE)} {_list('labels', 50, _LABELS)}"
)
_COMMIT_STATE = f"statusCheckRollup {{ state }} associatedPullRequests(first: 1) {_SUM}"
#: Kinds of timeline events with what they hold beside their time and actor, by where they occur.
TIMELINE = {
    "AssignedEvent": "assignee { ... on User { login } }", "UnassignedEvent": "assignee { ... on User { login } }", "LabeledEvent": "label { id name }", "UnlabeledEvent": "label { id name }",
    "MilestonedEvent": "milestoneTitle", "DemilestonedEvent": "milestoneTitle", "ClosedEvent": "closer { __typename ... on PullRequest { number } ... on Commit { oid } }", "ReopenedEvent": "id",
    "CrossReferencedEvent": "source { __typename ... on Issue { number } ... on PullRequest { number } }", "ConnectedEvent": "subject { __typename ... on Issue { number } ... on PullRequest { number } }", "DisconnectedEvent": "id",
}
PR_TIMELINE = TIMELINE | {
    "ReviewRequestedEvent": "requestedReviewer { __typename ... on User { login } ... on Team { name slug } }", "ReviewRequestRemovedEvent": "id", "ReadyForReviewEvent": "id", "ConvertToDraftEvent": "id", "MergedEvent": "mergeRefName commit { oid }",
    "HeadRefForcePushedEvent": "beforeCommit { oid } afterCommit { oid }", "HeadRefDeletedEvent": "headRefName", "HeadRefRestoredEvent": "id", "DeployedEvent": "deployment { databaseId environment state }",
}


def _happenings(kinds: dict[str, str]) -> str:
    return "__typename " + " ".join(f"... on {k} {{ createdAt actor {_WHO} {v} }}" for k, v in kinds.items())


@dataclass(frozen=True)
class Resource:
    """A connection of the repository: the kind of its nodes, where it lies, its arguments and fields."""

    kind: str
    path: tuple[str, ...]
    fields: str
    arguments: str = ""
    variables: str = ""
    window: Window | None = None
    page_size: int = 50
    parent: str | None = None  # the kind whose number each query asks for
    carried: tuple[tuple[str, str], ...] = ()  # what a child's JSON says of its parent: new name, the parent's field
    profile: str | None = None  # the switch that turns it on

    @property
    def query(self) -> str:
        """The text of the query for one page."""
        return self._query(self.fields, self.variables)

    @property
    def steps(self) -> str:
        """The same without the nodes' fields: how many nodes a page has, and where the next one begins."""
        return self._query("__typename", ", ".join(v for v in self.variables.split(", ") if v and re.search(re.escape(v.split(":")[0]) + r"\b", self.arguments)))

    def _query(self, fields: str, variables: str) -> str:
        inner = f"{self.path[-1]}(first: $pageSize, after: $cursor{', ' if self.arguments else ''}{self.arguments}) {{ totalCount pageInfo {{ hasNextPage endCursor }} nodes {{ {fields} }} }}"
        for step in reversed(self.path[:-1]):
            inner = f"{STEPS.get(step, step)} {{ {f'... on Commit {{ {inner} }}' if step == 'target' else inner} }}"
        number = ", $number: Int!" if self.parent else ""
        return f"query($owner: String!, $repo: String!, $cursor: String, $pageSize: Int!{number}{', ' if variables else ''}{variables}) {{ repository(owner: $owner, name: $repo) {{ {inner} }} rateLimit {{ cost remaining resetAt }} }}"


#: How a step of a path is asked for where that isn't its name.
STEPS = {"issue": "issue(number: $number)", "pullRequest": "pullRequest(number: $number)", "discussion": "discussion(number: $number)"}
_ASC, _DESC = "orderBy: {field: %s, direction: ASC}", "orderBy: {field: %s, direction: DESC}"
_CREATED, _FALLING = Window(("createdAt",), True), Window(("createdAt",), False)
_PR, _ISSUE = (("__pr_number", "number"),), (("__issue_number", "number"),)
_REVIEW = f"id state bodyText submittedAt createdAt authorAssociation author {_WHO} commit {{ oid }}"

#: Fixed values of the host's interface: the names of its connections, arguments and fields.
RESOURCES: dict[str, Resource] = {
    "issues": Resource("issue", ("issues",), f"{_ABOUT} stateReason isPinned", _ASC % "UPDATED_AT" + ", filterBy: {since: $since}", "$since: DateTime", Window(("updatedAt",), True, True)),
    "pull_requests": Resource("pull_request", ("pullRequests",), f"{_ABOUT} isDraft merged mergedAt headRefName baseRefName headRefOid reviewDecision additions deletions changedFiles mergedBy {_WHO} headRepository {{ nameWithOwner }} baseRepository {{ nameWithOwner }} autoMergeRequest {{ mergeMethod enabledBy {_WHO} }} statusCheckRollup @include(if: $withStatusChecks) {{ state }} reviews {_SUM} {_list('commits', 100, _OID)}", _ASC % "CREATED_AT", "$withStatusChecks: Boolean = true", Window(("createdAt", "updatedAt"), True)),
    "branches": Resource("branch", ("refs",), f"id name target {{ oid ... on Commit {{ committedDate author {{ user {{ login }} }} }} }} associatedPullRequests {_SUM} branchProtectionRule {{ requiresApprovingReviews requiredApprovingReviewCount requiresStatusChecks requiredStatusCheckContexts requiresLinearHistory allowsForcePushes allowsDeletions isAdminEnforced requiresConversationResolution requiresCodeOwnerReviews }}", 'refPrefix: "refs/heads/"'),
    "tags": Resource("tag", ("refs",), f"id name target {{ __typename oid ... on Commit {{ committedDate signature {{ isValid }} author {{ name email user {{ login }} }} {_COMMIT_STATE} }} ... on Tag {{ message tagger {{ name email date user {{ login }} }} target {{ oid ... on Commit {{ {_COMMIT_STATE} }} }} }} }}", 'refPrefix: "refs/tags/"'),
    "milestones": Resource("milestone", ("milestones",), f"id number title description state url dueOn createdAt updatedAt closedAt progressPercentage creator {_WHO} issues(states: OPEN) {_SUM} closedIssues: issues(states: CLOSED) {_SUM} pullRequests(states: OPEN) {_SUM} mergedPRs: pullRequests(states: MERGED) {_SUM} closedUnmergedPRs: pullRequests(states: CLOSED) {_SUM}"),
    "issue_comments": Resource("issue_comment", ("issue", "comments"), _TALK, parent="issue", carried=_ISSUE),
    "pr_comments": Resource("pr_comment", ("pullRequest", "comments"), _TALK, parent="pull_request", carried=_PR),
    "pr_commits": Resource("commit_of_pr", ("pullRequest", "commits"), "commit { oid }", parent="pull_request", carried=(("number", "number"),), page_size=100),
    "pr_reviews": Resource("review", ("pullRequest", "reviews"), f"{_REVIEW} {_list('comments', 50, _LINE, ' @include(if: $withReviewComments)')}", variables="$withReviewComments: Boolean = true", parent="pull_request", carried=_PR, page_size=30, profile="withReviews"),
    "pr_threads": Resource("review_thread", ("pullRequest", "reviewThreads"), f"id isResolved isOutdated resolvedBy {_WHO} {_list('comments', 50, _MARK)}", parent="pull_request", carried=_PR, profile="withThreads"),
    "pr_timeline": Resource("timeline", ("pullRequest", "timelineItems"), _happenings(PR_TIMELINE), parent="pull_request", carried=(*_PR, ("__pr_head_ref", "headRefName"), ("__parent_type", "=PullRequest")), profile="withTimeline"),
    "issue_timeline": Resource("timeline", ("issue", "timelineItems"), _happenings(TIMELINE), parent="issue", carried=(*_ISSUE, ("__parent_type", "=Issue")), profile="withTimeline"),
    "commits": Resource("commit", ("defaultBranchRef", "target", "history"), f"id oid message committedDate authoredDate additions deletions changedFilesIfAvailable parents {_SUM} author {{ name user {{ login }} }} committer {{ name user {{ login }} }} signature {{ isValid signer {{ login }} }} {_list('associatedPullRequests', 10, _NUMBER)} {_list('checkSuites', 10, _SUITE, ' @include(if: $withStatusChecks)')}", "since: $sinceGit", "$sinceGit: GitTimestamp, $withStatusChecks: Boolean = true", Window(("committedDate",), False, True)),
    "deployments": Resource("deployment", ("deployments",), f"id databaseId environment state task createdAt commit {{ oid }} ref {{ name }} creator {_WHO} {_list('statuses', 50, _STATUS)}", _DESC % "CREATED_AT", window=_FALLING, page_size=100),
    "releases": Resource("release", ("releases",), f"id databaseId tagName name description url isPrerelease isDraft createdAt publishedAt updatedAt author {_WHO} tag {{ id target {{ __typename oid ... on Tag {{ target {{ oid }} }} }} }} {_list('releaseAssets', 100, _ASSET)}", _ASC % "CREATED_AT", window=_CREATED),
    "discussions": Resource("discussion", ("discussions",), f"id number title url locked bodyText createdAt updatedAt upvoteCount answerChosenAt answerChosenBy {_WHO} category {{ name }} author {_WHO} {_list('labels', 20, 'id')} reactions {_SUM} {_list('comments', 50, _REPLIED)}", _ASC % "CREATED_AT", window=_CREATED, profile="withDiscussions"),
    "discussion_comments": Resource("discussion_comment", ("discussion", "comments"), _REPLIED, parent="discussion", carried=(("__discussion_number", "number"),), profile="withDiscussions"),
}
_HISTORY = "defaultBranchRef { name target { ... on Commit { kept: history(since: $sinceGit) { totalCount } history { totalCount } } } }"
#: The query of a repository's own attributes and of how many nodes its connections have.
REPOSITORY = (
    "query($owner: String!, $repo: String!, $since: DateTime, $sinceGit: GitTimestamp) { repository(owner: $owner, name: $repo) { nameWithOwner description url createdAt updatedAt pushedAt isPrivate isFork isArchived isDisabled stargazerCount forkCount diskUsage "
    f"hasIssuesEnabled hasDiscussionsEnabled hasWikiEnabled watchers {_SUM} primaryLanguage {{ name }} licenseInfo {{ spdxId name }} issues(filterBy: {{since: $since}}) {_SUM} allIssues: issues {_SUM} pullRequests {_SUM} discussions {_SUM} releases {_SUM} milestones {_SUM} deployments {_SUM} "
    f'tags: refs(refPrefix: "refs/tags/") {_SUM} branches: refs(refPrefix: "refs/heads/") {_SUM} {_HISTORY} }} rateLimit {{ cost remaining resetAt }} }}'
)

#: What each profile turns on.
SWITCHES = ("withReviews", "withReviewComments", "withThreads", "withTimeline", "withStatusChecks", "withDiscussions", "withFileObjects")
PROFILES = {
    "minimal": {"withDiscussions"},
    "standard": {"withReviews", "withTimeline", "withStatusChecks", "withDiscussions"},
    "complete": set(SWITCHES),
}


def profile(name: str = "standard") -> dict[str, bool]:
    """The switches of a profile; an unknown name is the standard one."""
    on = PROFILES.get(name.lower(), PROFILES["standard"])
    return {s: s in on for s in SWITCHES}


def resources(name: str = "standard") -> dict[str, Resource]:
    """The resources that a profile reads."""
    on = profile(name)
    return {k: r for k, r in RESOURCES.items() if r.profile is None or on[r.profile]}


def _step(size: int, *steps: tuple[float, int]) -> int:
    return next(v for most, v in steps if size < most)


def page_sizes(pull_requests: int = 0, reviews: int = 0, discussions: int = 0, points: int | None = None) -> dict[str, int]:
    """Nodes to ask for at once: fewer where nodes are heavy and many, or points are short. The steps are fixed values."""
    inf = float("inf")
    out = {k: r.page_size for k, r in RESOURCES.items()}
    out["pull_requests"] = _step(pull_requests, (500, 50), (1_000, 40), (2_000, 30), (inf, 20))
    out["pr_reviews"] = _step(reviews, (200, 30), (1_000, 20), (inf, 10))
    out["discussions"] = _step(discussions, (200, 50), (500, 30), (inf, 20))
    if points is not None and points < 1_000:
        for k, most in (("pr_reviews", 10), ("pr_comments", 30), ("pr_timeline", 30), ("discussions", 20)):
            out[k] = min(out[k], most)
    return out


def connection(client: Client, resource: Resource, page_size: int | None = None, **variables: Any) -> Iterator[dict]:
    """The nodes of a connection, page by page. It ends when there is no next page, no cursor, or the cursor stands still;
    empty nodes are left out. ConnectorError if the answer has no such connection."""
    cursor, pages = None, replace(resource) if page_size is None else replace(resource, page_size=page_size)
    while True:
        at: Any = client.graphql(pages.query, cursor=cursor, pageSize=pages.page_size, **variables)
        for step in ("repository", *pages.path):
            at = (at or {}).get(step)
            if at is None:
                raise FatalError(f"the answer has no {step!r}")
        yield from (n for n in at.get("nodes") or [] if n)
        said = at.get("pageInfo") or {}
        if not said.get("hasNextPage") or not said.get("endCursor") or said["endCursor"] == cursor:
            return
        cursor = said["endCursor"]


def nodes(client: Client, name: str, since: str | None = None, until: str | None = None, parents: list[dict] | None = None, page_size: int | None = None, switches: dict[str, bool] | None = None) -> Iterator[tuple[str, dict]]:
    """(kind, node) of a resource within a window; ``parents`` are the nodes whose children are read. Reading ends where the
    order of the pages says that nothing more can be in the window."""
    r, a, b = RESOURCES[name], moment(since), moment(until)
    asked = {k: v for k, v in (("since", since), ("sinceGit", since), *(switches or {}).items()) if f"${k}:" in r.variables}
    for parent in (parents or []) if r.parent else [None]:
        more = {"number": int(parent["number"])} if parent else {}
        said = {new: old[1:] if old.startswith("=") else parent.get(old) for new, old in r.carried} if parent else {}
        for node in connection(client, r, page_size, **asked, **more):
            place = r.window.place(node, a, b) if r.window else "in"
            if place == "end":
                break
            if place == "in":
                if r.kind == "commit_of_pr":
                    node = {"__commit": (node.get("commit") or {}).get("oid")}
                yield r.kind, said | whole(client, node, NESTED.get(r.kind))


def workflow_runs(client: Client, since: str | None = None, until: str | None = None) -> Iterator[tuple[str, dict]]:
    """Workflow runs with their jobs, by page number; a range of days goes to the host when there is a first one."""
    window = {"created": f"{since[:10]}..{(until or datetime.now(timezone.utc).isoformat())[:10]}"} if since else {}
    for page in client.pages(f"/repos/{client.owner}/{client.name}/actions/runs", inside="workflow_runs", **window):
        for run in page:
            jobs = [j for p in client.pages(f"/repos/{client.owner}/{client.name}/actions/runs/{run['id']}/jobs", inside="jobs") for j in p]
            yield "workflow_run", run | {"extracted_jobs": jobs}


def commit_files(client: Client, shas: list[str]) -> Iterator[tuple[str, dict]]:
    """The files of commits, one request each; all pages of a commit's files."""
    for sha in shas:
        whole: dict | None = None
        page = 1
        while True:
            got = client.rest(f"/repos/{client.owner}/{client.name}/commits/{sha}", page=page, per_page=100)
            files = [{"path": f.get("filename"), "status": f.get("status"), "previous_path": f.get("previous_filename")} for f in got.get("files") or []]
            if whole is None:
                whole = {"sha": sha, "files": files, "stats": got.get("stats"), "verification_reason": ((got.get("commit") or {}).get("verification") or {}).get("reason")}
            else:
                whole["files"] += files
            if len(files) < 100:
                break
            page += 1
        yield "commit_files", whole


@dataclass
class Part(InputPartition):
    """What one task reads: a resource, of some parents if it has any."""

    resource: str
    parents: list[dict] = field(default_factory=list)


class NodeReader(DataSourceReader):
    """Fetches nodes on the executors."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def _client(self) -> Client:
        o = self.options
        owner, name = o["repository"].split("/")
        return Client(owner, name, o["rest"], o["graphql"], o.get("token", ""), retry=Retry(int(o.get("tries", 5)), float(o.get("pause", 1))))

    def partitions(self) -> list[Part]:
        """One part for each resource; those with parents (JSON lines of number and what children carry) in runs of them."""
        per, wanted = int(self.options.get("parents_per_part", 200)), self.options.get("resources", "").split(",")
        rows = json.loads(self.options.get("parents", "[]"))
        out = []
        for name in filter(None, wanted):
            if name in RESOURCES and RESOURCES[name].parent or name == "commit_files":
                out += [Part(name, rows[at : at + per]) for at in range(0, len(rows), per)]
            else:
                out.append(Part(name))
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        o, client = self.options, self._client()
        if partition.resource == "workflow_runs":
            found = workflow_runs(client, o.get("since"), o.get("until"))
        elif partition.resource == "commit_files":
            found = commit_files(client, [p["oid"] for p in partition.parents])
        else:
            found = nodes(client, partition.resource, o.get("since"), o.get("until"), partition.parents, int(o["page_size"]) if "page_size" in o else None, profile(o.get("profile", "standard")))
        for kind, node in found:
            yield o["repo"], kind, json.dumps(node, ensure_ascii=False)


@dataclass
class Page(InputPartition):
    """What one task of a stream reads: so many nodes of a resource after a cursor."""

    resource: str
    after: str
    first: int


class NodeStreamReader(DataSourceStreamReader):
    """Resources without parents as a stream. An offset is the cursor of each resource and how many nodes stand before it, so a
    query that is stopped between pages goes on where its checkpoint says.

    The driver only walks the cursors (pages without fields), at most ``pages_per_batch`` of them a batch over all resources: that is
    the budget which the batch's tasks share, one request each. A resource must come in an order that new nodes end
    (by time of creation or update, rising); at its end the stream waits for more.
    """

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.names = [n for n in self.options.get("resources", "").split(",") if n]
        if unfit := [n for n in self.names if n not in RESOURCES or RESOURCES[n].parent or (RESOURCES[n].window and not RESOURCES[n].window.ascending)]:
            raise ValueError(f"no rising resources without parents: {unfit}")
        self.size = int(self.options.get("page_size", 50))
        self.at: dict | None = None
        self.known: dict[tuple[str, str, int], tuple[str, int, bool]] = {}

    def _asked(self, r: Resource) -> dict:
        o = self.options
        return {k: v for k, v in (("since", o.get("since")), ("sinceGit", o.get("since")), *profile(o.get("profile", "standard")).items()) if f"${k}:" in r.variables}

    def _step(self, client: Client, name: str, after: str, first: int) -> tuple[str, int, bool]:
        """Where the page after a cursor ends, its nodes, and whether more follow."""
        key = name, after, first
        if key not in self.known:
            r = RESOURCES[name]
            at: Any = client.graphql(r.steps, cursor=after or None, pageSize=first, **{k: v for k, v in self._asked(r).items() if f"${k}:" in r.steps})
            for step in ("repository", *r.path):
                at = (at or {}).get(step)
                if at is None:
                    raise FatalError(f"the answer has no {step!r}")
            said, n = at.get("pageInfo") or {}, min(len(at.get("nodes") or []), first)
            found = (said.get("endCursor") or after, n, bool(said.get("hasNextPage"))) if n else (after, 0, False)
            if n < first:
                return found  # the last page may grow
            self.known[key] = found
        return self.known[key]

    def initialOffset(self) -> dict:
        return {n: {"after": "", "nodes": 0} for n in self.names}

    def latestOffset(self) -> dict:
        self.at = self.at or self.initialOffset()
        client, left, open_ = NodeReader(self.options)._client(), int(self.options.get("pages_per_batch", 20)), list(self.names)
        now = {n: dict(self.at[n]) for n in self.names}
        while open_ and left > 0:
            for name in list(open_):
                if left <= 0:
                    break
                left -= 1
                end, n, more = self._step(client, name, now[name]["after"], self.size)
                if not n or end == now[name]["after"]:
                    open_.remove(name)
                    continue
                now[name] = {"after": end, "nodes": now[name]["nodes"] + n}
                if not more:
                    open_.remove(name)
        self.at = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Page]:
        """The pages between two offsets, also after a restart: the same nodes, whatever has been added since."""
        self.at = self.at or end
        client, out = NodeReader(self.options)._client(), []
        for name in self.names:
            after, left = start[name]["after"], end[name]["nodes"] - start[name]["nodes"]
            while left > 0:
                first = min(self.size, left)
                out.append(Page(name, after, first))
                after, n, _ = self._step(client, name, after, first) if left > first else (after, first, False)
                if not n:
                    raise FatalError(f"{left} nodes of {name!r} are gone")
                left -= n
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        o, r, client = self.options, RESOURCES[partition.resource], NodeReader(self.options)._client()
        at: Any = client.graphql(r.query, cursor=partition.after or None, pageSize=partition.first, **self._asked(r))
        for step in ("repository", *r.path):
            at = at[step]
        a, b = moment(o.get("since")), moment(o.get("until"))
        for node in (n for n in (at.get("nodes") or [])[: partition.first] if n):
            if not r.window or r.window.place(node, a, b) == "in":
                yield o["repo"], r.kind, json.dumps(whole(client, node, NESTED.get(r.kind)), ensure_ascii=False)

    def commit(self, end: dict) -> None:
        self.at = self.at or end
        self.known.clear()


class NodeSource(DataSource):
    """``spark.read.format("host_nodes")``: repo, kind, node. Options: repository (owner/name), repo (its object id), rest,
    graphql, token, resources (comma-separated), parents (a JSON list), since, until, profile, page_size, tries, pause.
    ``spark.readStream`` too, for resources without parents that come in rising order; option pages_per_batch."""

    @classmethod
    def name(cls) -> str:
        return "host_nodes"

    def schema(self) -> str:
        return "repo string, kind string, node string"

    def reader(self, schema) -> NodeReader:
        return NodeReader(self.options)

    def streamReader(self, schema) -> NodeStreamReader:
        return NodeStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(NodeSource)


def landed(spark: SparkSession, path: str, name: str, repo: str) -> DataFrame:
    """The nodes (repo, kind, node) of landed answers: JSON lines, each the whole answer to one page's query."""
    r = RESOURCES[name]
    inside = F.from_json(F.get_json_object("value", "$.data.repository." + ".".join(r.path) + ".nodes"), "array<string>")
    rows = spark.read.text(path).select(F.explode(inside).alias("node")).filter("node is not null")
    return rows.select(F.lit(repo).alias("repo"), F.lit(r.kind).alias("kind"), "node")


def in_window(landed_nodes: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Landed nodes within a window of time, kind by kind; kinds without one all stay."""
    windows = {r.kind: r.window for r in RESOURCES.values() if r.window}
    keep = F.lit(True)
    for kind, w in windows.items():
        keep = F.when(F.col("kind") == kind, w.filter(since, until)).otherwise(keep)
    return landed_nodes.filter(keep)


def of_profile(landed_nodes: DataFrame, name: str = "standard") -> DataFrame:
    """Landed nodes of the kinds that a profile reads."""
    on = profile(name)
    off = {r.kind for r in RESOURCES.values() if r.profile and not on[r.profile]} | (set() if on["withReviewComments"] else {"review_comment"}) | (set() if on["withFileObjects"] else {"commit_files"})
    return landed_nodes.filter(~F.col("kind").isin(*sorted(off))) if off else landed_nodes


def overflowing(landed_nodes: DataFrame) -> DataFrame:
    """repo, kind, id, number, list, total, embedded: nodes of landed answers with a list that is not all there, so that its nodes
    have to be read by themselves (`whole` does, where nodes are read by this source). ``list`` is a path (comments, comments.replies);
    of the inner one each outer node has its row."""
    nothing = F.array().cast("array<string>")
    held = lambda node, name: F.get_json_object(node, f"$.{name}")
    inside = lambda node: F.coalesce(F.from_json(F.get_json_object(node, "$.nodes"), "array<string>"), nothing)
    row = lambda path, id_, said: F.struct(F.lit(path).alias("list"), id_.alias("id"), F.get_json_object(said, "$.totalCount").cast("long").alias("total"), F.size(inside(said)).alias("embedded"))
    inner_rows = lambda name, x: F.transform(inside(held("node", name)), lambda n: row(f"{name}.{x}", held(n, "id"), held(n, x)))
    kinds = []
    for kind, lists in NESTED.items():
        own = [F.array(row(name, held("node", "id"), held("node", name))) for name in lists.of]
        own += [inner_rows(name, x) for name, inner in lists.inner.items() for x in inner.of]
        kinds.append((kind, F.flatten(F.array(*own))))
    found = F.coalesce(*[F.when(F.col("kind") == k, rows) for k, rows in kinds])
    rows = landed_nodes.select("repo", "kind", held("node", "number").cast("long").alias("number"), F.explode(found).alias("r"))
    return rows.select("repo", "kind", "r.id", "number", "r.list", "r.total", "r.embedded").filter("total > embedded")
