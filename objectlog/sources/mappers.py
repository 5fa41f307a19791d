"""Landed API nodes as an object log.

Input is one row for each node: repo (the repository's object id), kind, node (JSON text). Each kind has a declaration of
its object, its attributes, its links and its events, all Column expressions; one projection for each kind makes the facts
of all of them, and `assemble` turns facts into the five tables. Existence is settled by joins over the whole input, so
nodes may come in any order: a link to something that must exist is dropped where it doesn't, other targets that no node
describes become stub objects. Event ids are hashes of the event, so a rerun gives the same log.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..log import ObjectLog
from ..operators.crowds import met, repeated
from ..schema import EPOCH
from .staging import staged


def repo() -> Column:
    return F.col("repo")


def get(path: str, of: Column | None = None) -> Column:
    """Text at a JSON path; an empty text counts as missing."""
    return F.nullif(F.get_json_object(F.col("node") if of is None else of, f"$.{path}"), F.lit(""))


def items(path: str, of: Column | None = None) -> Column:
    """Elements of a JSON array as JSON texts; none where it is missing."""
    return F.coalesce(F.from_json(F.get_json_object(F.col("node") if of is None else of, f"$.{path}"), "array<string>"), F.array().cast("array<string>"))


def oid(kind: str, raw: Column) -> Column:
    return F.when(raw.isNotNull(), scalars.make_id(repo(), F.lit(kind), raw))


def user(path: str, of: Column | None = None) -> Column:
    return oid("user", get(path, of))


def flag(path: str) -> Column:
    return F.coalesce((get(path) == "true").cast("int"), F.lit(0))


def number(path: str) -> Column:
    return F.coalesce(get(path), F.lit("0"))


def time(path: str, of: Column | None = None) -> Column:
    return scalars.safe_timestamp(get(path, of))


_REL = "struct<oid:string,otype:string,qualifier:string,stub:boolean>"


def rel(target: Column, otype: str | Column, qualifier: str | Column, stub: bool = True) -> Column:
    """A link to an object; ``stub`` says whether it may come into being by the link alone."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(target.alias("oid"), text(otype).alias("otype"), text(qualifier).alias("qualifier"), F.lit(stub).alias("stub"))


def rels(*links: Column) -> Column:
    return F.filter(F.array(*links), lambda r: r["oid"].isNotNull())


def each(array: Column, link: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(array, link), lambda r: r["oid"].isNotNull())


def event(activity: str | Column, at: Column, links: Column, when: Column | None = None, **attrs: Column | str) -> Column:
    """An event; null (and left out) where its time is null or ``when`` isn't true."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    bag = F.map_from_arrays(F.array(*[F.lit(k) for k in attrs]), F.array(*[text(v) for v in attrs.values()])) if attrs else F.lit(None).cast("map<string,string>")
    made = F.struct(text(activity).alias("activity"), at.alias("time"), bag.alias("attrs"), links.alias("rels"))
    return F.when(at.isNotNull() & (F.lit(True) if when is None else F.coalesce(when, F.lit(False))), made)


@dataclass
class Kind:
    """How a node of one kind maps: its object (id, type), attributes, links, events and further objects' links."""

    id: Column
    otype: str
    attrs: dict[str, Column] = field(default_factory=dict)
    links: list[Column] = field(default_factory=list)  # arrays of rel
    events: list[Column] = field(default_factory=list)  # structs of event
    owns: bool = True  # whether the node is the object itself; else it only adds to one that must exist
    later: Column | None = None  # a partial snapshot: (time, changed_field, attrs)
    many: Column | None = None  # an array of events


def _counts(path: str, of: Column | None = None) -> Column:
    return F.coalesce(get(f"{path}.totalCount", of), F.lit("0"))


def _reactions() -> dict[str, Column]:
    groups = F.transform(items("reactionGroups"), lambda g: F.struct(get("content", g).alias("content"), F.coalesce(get("reactors.totalCount", g).cast("bigint"), F.lit(0)).alias("n")))
    found = scalars.reactions(groups)
    return {f"reactions_{n.lower()}": found[n.lower()] for n in (*scalars.REACTIONS, "POSITIVE", "NEGATIVE")}


def _is_pr() -> Column:
    return get("__parent_type") == "PullRequest"


def _parent() -> Column:
    return F.when(_is_pr(), oid("pr", F.coalesce(get("__pr_number"), get("__number")))).otherwise(oid("issue", F.coalesce(get("__issue_number"), get("__number"))))


def _root() -> Column:
    return rel(repo(), "Repository", "contained_in")


def _context() -> Column:
    return rel(repo(), "Repository", "context")


def _both(pr: str, issue: str) -> Column:
    return F.when(_is_pr(), pr).otherwise(issue)


def _people(created: bool = True) -> list[Column]:
    out = [rels(_root(), rel(user("author.login"), "User", "created_by"))] if created else []
    out.append(each(items("assignees.nodes"), lambda a: rel(user("login", a), "User", "assigned_to")))
    out.append(each(items("labels.nodes"), lambda x: rel(oid("label", F.coalesce(get("id", x), get("name", x))), "Label", "has_label")))
    out.append(rels(rel(oid("milestone", get("milestone.id")), "Milestone", "belongs_to_milestone", False)))
    return out


def _base_attrs() -> dict[str, Column]:
    text = {"number": get("number"), "title": scalars.shortened(get("title"), 255), "state": F.coalesce(get("state"), F.lit("OPEN")), "url": get("url"), "github_node_id": get("id"), "locked": flag("locked"), "locked_reason": get("activeLockReason")}
    more = {"author_association": get("authorAssociation"), "updated_at": time("updatedAt"), "closed_at": F.when(get("closedAt").isNotNull(), time("closedAt")), "body_length": F.length(F.coalesce(get("bodyText"), F.lit("")))}
    return text | more | {f"{n}_count": _counts(n) for n in ("reactions", "participants", "comments")} | _reactions()


def _opened(me: Column, otype: str, at: Column, activity: str, **attrs: Column | str) -> Column:
    return event(activity, at, rels(rel(me, otype, "subject"), _context(), rel(user("author.login"), "User", "actor")), **attrs)


def _issue() -> Kind:
    me = oid("issue", get("number"))
    attrs = _base_attrs() | {"state_reason": get("stateReason"), "body_text": scalars.shortened(get("bodyText"), 2000), "is_pinned": flag("isPinned")}
    return Kind(me, "Issue", attrs, _people(), [_opened(me, "Issue", time("createdAt"), "IssueOpened", source="graphql")])


def _pull_request() -> Kind:
    me = oid("pr", get("number"))
    head, base = get("headRepository.nameWithOwner"), get("baseRepository.nameWithOwner")
    attrs = _base_attrs() | {n: flag(p) for n, p in (("is_draft", "isDraft"), ("merged", "merged"))} | {n: get(p) for n, p in (("head_ref", "headRefName"), ("base_ref", "baseRefName"), ("head_sha", "headRefOid"), ("review_decision", "reviewDecision"), ("merged_by", "mergedBy.login"), ("am_method", "autoMergeRequest.mergeMethod"), ("am_enabled_by", "autoMergeRequest.enabledBy.login"))}
    attrs |= {n: number(p) for n, p in (("additions", "additions"), ("deletions", "deletions"), ("changed_files", "changedFiles"))}
    attrs |= {"total_changes": number("additions").cast("bigint") + number("deletions").cast("bigint"), "head_repo": head, "is_fork_pr": (head.isNotNull() & ~head.eqNullSafe(base)).cast("int"), "am_enabled": get("autoMergeRequest").isNotNull().cast("int"), "commits_count": _counts("commits"), "merged_at": F.when(get("mergedAt").isNotNull(), time("mergedAt"))}
    links = [*_people(), rels(rel(oid("branch", get("baseRefName")), "Branch", "targets_branch", False), rel(oid("branch", get("headRefName")), "Branch", "source_branch", False)), each(items("commits.nodes"), lambda c: rel(oid("commit", F.coalesce(get("commit.oid", c), get("oid", c))), "Commit", "contains_commit"))]
    state = get("statusCheckRollup.state")
    events = [_opened(me, "PullRequest", time("createdAt"), "PROpened", is_draft=flag("isDraft"), source="graphql"), event("PRCIState", time("updatedAt"), rels(rel(me, "PullRequest", "subject"), _context()), state.isNotNull(), ci_state=state)]
    return Kind(me, "PullRequest", attrs, links, events)


def _commit() -> Kind:
    me, message = oid("commit", get("oid")), get("message")
    analysis = scalars.conventional_commit(message)
    author = F.coalesce(get("author.user.login"), get("author.name"))
    committer = F.coalesce(get("committer.user.login"), get("committer.name"))
    other = F.when(~committer.eqNullSafe(author), committer)
    suites = items("checkSuites.nodes")
    done = F.filter(suites, lambda s: get("conclusion", s).isNotNull())
    shown = F.coalesce(F.get(done, F.lit(0)), F.get(suites, F.lit(0)))
    merge = (_counts("parents").cast("int") > 1).cast("int")
    attrs = {"sha": get("oid"), "message": scalars.shortened(message, 500), "committed_date": get("committedDate"), "authored_date": get("authoredDate"), "author_login": author, "committer_login": committer, "additions": number("additions"), "deletions": number("deletions"), "changed_files": number("changedFilesIfAvailable"), "is_merge_commit": merge}
    attrs |= {k: analysis[k].cast("string") for k in ("is_conventional", "commit_type", "scope", "is_breaking", "subject")}
    people = [rel(oid("user", author), "User", "authored_by"), rel(oid("user", other), "User", "committed_by"), rel(user("signature.signer.login"), "User", "signed_by")]
    links = [rels(*people), each(analysis["issues"], lambda n: rel(oid("issue", n.cast("string")), "Issue", "references_issue", False)), each(suites, lambda s: rel(oid("workflow", get("workflowRun.databaseId", s)), "WorkflowRun", "tested_by", False))]
    created = event(
        "CommitCreated", time("committedDate"), rels(rel(me, "Commit", "subject"), _context(), *people), source="graphql", intent=analysis["commit_type"], is_merge_commit=merge, is_verified=flag("signature.isValid"), ci_status=get("status", shown), ci_conclusion=get("conclusion", shown),
        ci_failed=F.exists(suites, lambda s: get("conclusion", s) == "FAILURE").cast("int"), ci_completed_pct=F.when(F.size(suites) > 0, F.round(F.size(done) / F.size(suites) * 100).cast("int")).otherwise(0),
    )
    return Kind(me, "Commit", attrs, links, [created])


def _commit_of_pr() -> Kind:
    """Commit nodes once more: the pull requests that they name get the link."""
    me = oid("pr", get("number"))
    return Kind(me, "PullRequest", {}, [rels(rel(oid("commit", get("__commit")), "Commit", "contains_commit"))], owns=False)


def _comment(kind: str) -> Kind:
    me = oid("comment", get("id"))
    parent = {"issue": oid("issue", get("__issue_number")), "pr": oid("pr", get("__pr_number")), "review": oid("pr", get("__pr_number")), "discussion": oid("discussion", get("__discussion_number"))}[kind]
    otype = {"issue": "Issue", "pr": "PullRequest", "review": "PullRequest", "discussion": "Discussion"}[kind]
    created = time("createdAt")
    edited = F.when((get("updatedAt") != get("createdAt")) if kind == "review" else get("lastEditedAt").isNotNull(), time("updatedAt" if kind == "review" else "lastEditedAt"))
    bot = (F.coalesce(get("author.__typename"), F.lit("User")) == "Bot").cast("int")
    path, review = get("path"), oid("review", get("__review_id"))
    attrs = {"comment_type": F.lit(kind), "body_length": F.length(F.coalesce(get("bodyText"), F.lit(""))), "reactions_count": _counts("reactions"), "is_edited": edited.isNotNull().cast("int"), "edited_at": edited, "author_association": get("authorAssociation"), "is_minimized": flag("isMinimized"), "minimized_reason": get("minimizedReason"), "url": get("url"), "is_bot": bot}
    links = [rel(parent, otype, "comment_of"), rel(repo(), "Repository", "in_repo"), rel(user("author.login"), "User", "authored_by")]
    about = [rel(me, "Comment", "subject"), rel(parent, otype, "context")]
    if kind == "review":
        attrs |= {"path": path, "line": number("line"), "position": number("position"), "diff_hunk": scalars.shortened(get("diffHunk"), 500)}
        links += [rel(review, "Review", "belongs_to_review"), rel(oid("file", path), "File", "on_file")]
        about += [rel(review, "Review", "review_context"), rel(oid("file", path), "File", "on_file")]
    if kind == "discussion":
        attrs["is_answer"] = flag("isAnswer")
    links.append(rel(oid("comment", F.coalesce(get("replyTo.id"), get("__reply_to"))), "Comment", "replies_to"))
    events = [event("CommentCreated", created, rels(*about, rel(user("author.login"), "User", "actor")), comment_type=kind, author_association=get("authorAssociation"), is_bot=bot, path=path), event("CommentEdited", edited, rels(*about), edited != created, comment_type=kind, path=path)]
    return Kind(me, "Comment", attrs, [rels(*links)], events)


def _review() -> Kind:
    me, pr = oid("review", get("id")), oid("pr", get("__pr_number"))
    state, at = F.coalesce(get("state"), F.lit("COMMENTED")), time("submittedAt")
    activity = F.when(state == "APPROVED", "PRReviewApproved").when(state == "CHANGES_REQUESTED", "PRReviewChangesRequested").when(state == "DISMISSED", "PRReviewDismissed").otherwise("PRReviewCommented")
    length, commit = F.length(F.coalesce(get("bodyText"), F.lit(""))), oid("commit", get("commit.oid"))
    attrs = {"state": state, "body_length": length, "comments_count": _counts("comments"), "submitted_at": at, "author_role": get("authorAssociation")}
    links = rels(rel(pr, "PullRequest", "belongs_to_pr", False), rel(user("author.login"), "User", "submitted_by"), rel(commit, "Commit", "reviewed_at_commit"))
    about = rels(rel(me, "Review", "subject"), rel(pr, "PullRequest", "context"), rel(user("author.login"), "User", "reviewer"), rel(commit, "Commit", "reviewed_at_commit"), rel(repo(), "Repository", "repository"))
    return Kind(me, "Review", attrs, [links], [event(activity, at, about, review_state=state, body_length=length, author_role=get("authorAssociation"), source="graphql")])


def _review_thread() -> Kind:
    pr, comments = oid("pr", get("__pr_number")), items("comments.nodes")
    at = F.coalesce(get("resolvedAt"), get("createdAt", F.element_at(F.concat(F.array(F.lit(None).cast("string")), comments), -1)))
    about = rels(rel(pr, "PullRequest", "context", False), rel(user("resolvedBy.login"), "User", "resolved_by"))
    done = event("ReviewThreadResolved", scalars.safe_timestamp(at), about, get("isResolved") == "true", thread_id=get("id"), is_outdated=flag("isOutdated"), comments_count=F.size(comments), path=get("path", F.get(comments, F.lit(0))), source="graphql")
    return Kind(pr, "PullRequest", {}, [], [done], owns=False)


def _thread_comment() -> Kind:
    """A comment inside a thread: adds to the review comment, without an event."""
    me = oid("comment", get("id"))
    attrs = {"thread_id": get("__thread_id"), "original_line": get("originalLine"), "is_outdated": flag("outdated")}
    return Kind(me, "Comment", attrs, [rels(rel(oid("comment", get("replyTo.id")), "Comment", "replies_to"))], owns=False)


def _timeline() -> Kind:
    at, actor, kind = time("createdAt"), rel(user("actor.login"), "User", "actor"), get("__typename")
    me = lambda q: rel(_parent(), _both("PullRequest", "Issue"), q, False)
    label = oid("label", get("label.id"))
    assignee = user("assignee.login")
    reviewer_type = get("requestedReviewer.__typename")
    reviewer = F.when(reviewer_type == "User", user("requestedReviewer.login")).when(reviewer_type == "Team", oid("team", F.coalesce(get("requestedReviewer.slug"), get("requestedReviewer.name"))))
    merge, head, into = oid("commit", get("commit.oid")), oid("branch", get("__pr_head_ref")), oid("branch", get("mergeRefName"))
    deployment = oid("deployment", get("deployment.databaseId"))
    source = F.coalesce(get("source.number"), get("subject.number"))
    is_pull = F.coalesce(get("source.__typename"), get("subject.__typename")) == "PullRequest"
    other = F.when(is_pull, oid("pr", source)).otherwise(oid("issue", source))
    other_type = F.when(is_pull, "PullRequest").otherwise("Issue")
    on = lambda name, activity, links, **attrs: event(activity, at, links, kind == name, **attrs, source="timeline")
    events = [
        on("AssignedEvent", _both("PRAssigned", "IssueAssigned"), rels(me("target"), actor, rel(assignee, "User", "assignee"))),
        on("UnassignedEvent", _both("PRUnassigned", "IssueUnassigned"), rels(me("target"), actor, rel(assignee, "User", "unassigned"))),
        on("ReviewRequestedEvent", "PRReviewRequested", rels(me("target"), actor, rel(reviewer, F.coalesce(reviewer_type, F.lit("User")), "reviewer")), reviewer_type=reviewer_type),
        on("ReviewRequestRemovedEvent", "PRReviewRequestRemoved", rels(me("target"), actor)),
        on("ReadyForReviewEvent", "PRReadyForReview", rels(me("subject"), actor)),
        on("ConvertToDraftEvent", "PRConvertedToDraft", rels(me("subject"), actor)),
        on("LabeledEvent", "LabelAdded", rels(me("target"), rel(label, "Label", "label_applied"), actor), label_name=get("label.name")),
        on("UnlabeledEvent", "LabelRemoved", rels(me("target"), actor), label_name=get("label.name")),
        on("MilestonedEvent", "MilestoneAssigned", rels(me("target"), actor), milestone_title=get("milestoneTitle")),
        on("DemilestonedEvent", "MilestoneRemoved", rels(me("target"), actor), milestone_title=get("milestoneTitle")),
        on("ClosedEvent", _both("PRClosed", "IssueClosed"), rels(me("subject"), actor), closer_type=get("closer.__typename"), closer_ref=F.coalesce(get("closer.number"), get("closer.oid"))),
        on("ReopenedEvent", _both("PRReopened", "IssueReopened"), rels(me("subject"), actor)),
        on("MergedEvent", "PRMerged", rels(me("subject"), actor, rel(merge, "Commit", "merge_commit")), merge_ref=get("mergeRefName")),
        event("BranchMerged", at, rels(me("context"), actor, rel(head, "Branch", "merged_branch"), rel(into, "Branch", "merged_into"), rel(merge, "Commit", "merge_commit")), (kind == "MergedEvent") & head.isNotNull(), branch_name=get("__pr_head_ref"), merged_into=get("mergeRefName"), source="timeline"),
        on("HeadRefForcePushedEvent", "PRForcePushed", rels(me("target"), actor), before_sha=scalars.shortened(get("beforeCommit.oid"), 12), after_sha=scalars.shortened(get("afterCommit.oid"), 12)),
        on("HeadRefDeletedEvent", "BranchDeleted", rels(me("context"), actor, rel(oid("branch", F.coalesce(get("headRefName"), get("__pr_head_ref"))), "Branch", "deleted_branch")), branch_name=F.coalesce(get("headRefName"), get("__pr_head_ref"))),
        on("HeadRefRestoredEvent", "BranchRestored", rels(me("context"), actor, rel(head, "Branch", "subject")), branch_name=get("__pr_head_ref")),
        on("DeployedEvent", "DeploymentCreated", rels(me("context"), actor, rel(deployment, "Deployment", "deployment")), environment=get("deployment.environment"), state=get("deployment.state")),
        on("CrossReferencedEvent", "CrossReferenced", rels(me("target"), actor, rel(other, other_type, "referenced_by", False)), source_type=get("source.__typename")),
        on("ConnectedEvent", "IssueLinked", rels(me("target"), actor, rel(other, other_type, "linked_to", False))),
        on("DisconnectedEvent", "IssueUnlinked", rels(me("target"), actor)),
    ]
    closing = oid("pr", get("closer.number"))
    links = rels(
        rel(F.when(kind == "AssignedEvent", assignee), "User", "assigned_to"),
        rel(F.when(kind == "LabeledEvent", label), "Label", "has_label"),
        rel(F.when((kind == "ClosedEvent") & ~_is_pr() & (get("closer.__typename") == "PullRequest"), closing), "PullRequest", "closed_by", False),
        rel(F.when(kind == "CrossReferencedEvent", other), other_type, "references", False),
        rel(F.when(kind == "ConnectedEvent", other), other_type, "linked_issue", False),
    )
    return Kind(_parent(), "Issue", {}, [links], events, owns=False)


def _milestone() -> Kind:
    me, created, updated = oid("milestone", F.coalesce(get("id"), get("number"))), time("createdAt"), F.when(get("updatedAt").isNotNull(), time("updatedAt"))
    closed = F.when((get("state") == "CLOSED") & get("closedAt").isNotNull(), time("closedAt"))
    n = {c: _counts(p).cast("bigint") for c, p in (("open_issues", "issues"), ("closed_issues", "closedIssues"), ("open_prs", "pullRequests"), ("merged_prs", "mergedPRs"), ("closed_unmerged_prs", "closedUnmergedPRs"))}
    total = n["open_prs"] + n["merged_prs"] + n["closed_unmerged_prs"]
    attrs = {"number": get("number"), "title": scalars.shortened(get("title"), 255), "description": scalars.shortened(get("description"), 500), "state": F.coalesce(get("state"), F.lit("OPEN")), "due_on": F.when(get("dueOn").isNotNull(), time("dueOn")), "progress_pct": number("progressPercentage"), "total_prs": total, "rejection_rate_pct": scalars.percent(n["closed_unmerged_prs"], total), "creator_type": F.coalesce(get("creator.__typename"), F.lit("User")), "url": get("url")} | n
    about = rels(rel(me, "Milestone", "subject"), _context(), rel(user("creator.login"), "User", "actor"))
    events = [
        event("MilestoneCreated", created, about, title=scalars.shortened(get("title"), 255), source="graphql"),
        event("MilestoneClosed", closed, about, title=scalars.shortened(get("title"), 255), source="graphql"),
        event("MilestoneUpdated", updated, about, (updated != created) & ~updated.eqNullSafe(closed), title=scalars.shortened(get("title"), 255), progress_pct=number("progressPercentage"), source="graphql"),
    ]
    later = F.when(closed.isNotNull(), F.struct(closed.alias("time"), F.lit("state").alias("changed_field"), F.create_map(F.lit("state"), F.lit("CLOSED"), F.lit("progress_pct"), F.lit("100.0")).alias("attrs")))
    return Kind(me, "Milestone", attrs, [rels(_root(), rel(user("creator.login"), "User", "created_by"))], events, later=later)


def _branch() -> Kind:
    me, sha, login = oid("branch", get("name")), get("target.oid"), user("target.author.user.login")
    rule = "branchProtectionRule"
    guarded = get(rule).isNotNull().cast("int")
    attrs = {"name": get("name"), "github_node_id": get("id"), "head_sha": sha, "head_author_login": get("target.author.user.login"), "associated_pr_count": _counts("associatedPullRequests"), "protected": guarded, "required_status_checks": F.array_join(items(f"{rule}.requiredStatusCheckContexts"), ", "), "required_approving_review_count": number(f"{rule}.requiredApprovingReviewCount")}
    attrs |= {n: flag(f"{rule}.{p}") for n, p in (("requires_approving_reviews", "requiresApprovingReviews"), ("requires_status_checks", "requiresStatusChecks"), ("requires_linear_history", "requiresLinearHistory"), ("allows_force_pushes", "allowsForcePushes"), ("allows_deletions", "allowsDeletions"), ("is_admin_enforced", "isAdminEnforced"), ("requires_conversation_resolution", "requiresConversationResolution"), ("requires_code_owner_reviews", "requiresCodeOwnerReviews"))}
    commit = oid("commit", sha)
    about = rels(rel(me, "Branch", "observed_branch"), _context(), rel(commit, "Commit", "head_commit"), rel(login, "User", "actor"))
    return Kind(me, "Branch", attrs, [rels(_root(), rel(commit, "Commit", "current_head"), rel(login, "User", "last_author"))], [event("BranchSnapshot", time("target.committedDate"), about, source="graphql", protected=guarded)])


def _tag() -> Kind:
    """A tag as the host gives it, light (its target is a commit) or annotated (its target is a tag object), or with the
    fields of both already brought to one form. A target of another type is no tag."""
    me, v = oid("tag", F.coalesce(get("id"), get("name"))), scalars.semver(get("name"))
    target = get("target.__typename")
    of = lambda light, annotated, plain: F.when(target == "Commit", light).when(target == "Tag", annotated).when(target.isNull(), plain)
    who = of(F.coalesce(get("target.author.user.login"), get("target.author.name"), get("target.author.email")), F.coalesce(get("target.tagger.user.login"), get("target.tagger.name"), get("target.tagger.email")), F.coalesce(get("tagger.login"), get("tagger.name"), get("tagger.email")))
    sha = of(get("target.oid"), get("target.target.oid"), get("commit.sha"))
    message = of(F.lit(None).cast("string"), get("target.message"), get("message"))
    annotated = of(F.lit("0"), F.lit("1"), number("is_annotated"))
    ci = of(get("target.statusCheckRollup.state"), get("target.target.statusCheckRollup.state"), get("ci_state"))
    signed = of(flag("target.signature.isValid").cast("string"), F.lit("0"), number("is_signed"))
    pulls = of(_counts("target.associatedPullRequests"), _counts("target.target.associatedPullRequests"), number("release_pr_count"))
    at = scalars.safe_timestamp(of(get("target.committedDate"), get("target.tagger.date"), get("date")))
    tagger, commit, version = oid("user", who), oid("commit", sha), v.isNotNull().cast("int")
    attrs = {"name": get("name"), "github_node_id": get("id"), "is_annotated": annotated, "message": scalars.shortened(message, 500), "is_semver": version, "major": v["major"], "minor": v["minor"], "patch": v["patch"], "prerelease": v["prerelease"], "ci_state": ci, "is_signed": signed, "release_pr_count": pulls}
    about = rels(rel(me, "Tag", "created_item"), rel(repo(), "Repository", "repository_context"), rel(commit, "Commit", "tagged_commit"), rel(tagger, "User", "actor"))
    made = event("TagCreated", at, about, version=get("name"), change_type=scalars.release_kind(get("name")), is_annotated=annotated, is_semver=version, message=scalars.shortened(message, 500), source="graphql")
    return Kind(F.when(target.isNull() | target.isin("Commit", "Tag"), me), "Tag", attrs, [rels(_root(), rel(commit, "Commit", "tags_commit"), rel(tagger, "User", "created_by"))], [made])


def _release() -> Kind:
    me = oid("release", F.coalesce(get("databaseId"), get("id")))
    created, published, assets = time("createdAt"), F.when(get("publishedAt").isNotNull(), time("publishedAt")), items("releaseAssets.nodes")
    downloads = F.aggregate(assets, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(get("downloadCount", x).cast("bigint"), F.lit(0)))
    target = F.when(get("tag.target.__typename") == "Tag", get("tag.target.target.oid")).when(get("tag.target.__typename") == "Commit", get("tag.target.oid"))
    tag, commit = oid("tag", F.coalesce(get("tag.id"), get("tagName"))), oid("commit", target)
    count = F.coalesce(get("releaseAssets.totalCount"), F.size(assets).cast("string"))
    attrs = {"github_node_id": get("id"), "database_id": number("databaseId"), "tag_name": get("tagName"), "name": scalars.shortened(get("name"), 255), "description": scalars.shortened(get("description"), 500), "url": get("url"), "is_prerelease": flag("isPrerelease"), "is_draft": flag("isDraft"), "assets_count": count, "total_downloads": downloads, "updated_at": time("updatedAt")}
    links = rels(_root(), rel(user("author.login"), "User", "created_by"), rel(tag, "Tag", "tagged_as", False), rel(commit, "Commit", "points_to_commit"))
    about = rels(rel(me, "Release", "subject"), _context(), rel(user("author.login"), "User", "actor"), rel(commit, "Commit", "release_commit"), rel(tag, "Tag", "release_tag", False))
    events = [event("ReleaseCreated", created, about, tag=get("tagName"), is_prerelease=flag("isPrerelease"), is_draft=flag("isDraft"), source="graphql"), event("ReleasePublished", published, about, published != created, tag=get("tagName"), is_prerelease=flag("isPrerelease"), assets_count=count, total_downloads=downloads, source="graphql")]
    return Kind(me, "Release", attrs, [links], events)


def _deployment() -> Kind:
    me, commit, branch = oid("deployment", get("databaseId")), oid("commit", get("commit.oid")), oid("branch", get("ref.name"))
    attrs = {"environment": F.coalesce(get("environment"), F.lit("unknown")), "state": get("state"), "task": get("task"), "created_at": time("createdAt")}
    links = rels(rel(repo(), "Repository", "deployed_to"), rel(commit, "Commit", "deploys_commit"), rel(user("creator.login"), "User", "created_by"), rel(branch, "Branch", "deployed_from_branch"))
    about = rels(rel(me, "Deployment", "subject"), _context(), rel(user("creator.login"), "User", "actor"), rel(commit, "Commit", "on_commit"), rel(branch, "Branch", "on_branch"))

    def status(s: Column) -> Column:
        state = F.upper(get("state", s))
        activity = F.when(state == "SUCCESS", "DeploymentSucceeded").when(state == "FAILURE", "DeploymentFailed").when(state == "ERROR", "DeploymentError")
        return event(activity, time("createdAt", s), rels(rel(me, "Deployment", "subject"), _context()), activity.isNotNull(), state=state, description=scalars.shortened(get("description", s), 255), environment_url=get("environmentUrl", s), log_url=get("logUrl", s), source="graphql")

    created = event("DeploymentCreated", time("createdAt"), about, environment=attrs["environment"], task=get("task"), source="graphql")
    return Kind(me, "Deployment", attrs, [links], [created], many=F.transform(items("statuses.nodes"), status))


def _workflow_run() -> Kind:
    me, done = oid("workflow", get("id")), get("status") == "completed"
    start, end = scalars.safe_timestamp(F.coalesce(get("run_started_at"), get("created_at"))), time("updated_at")
    actor, commit = oid("user", F.coalesce(get("triggering_actor.login"), get("actor.login"))), oid("commit", get("head_sha"))
    attempt = F.coalesce(get("run_attempt"), F.lit("1"))
    attrs = {"run_id": get("id"), "name": F.coalesce(get("name"), F.lit("Unknown_workflow")), "conclusion": F.coalesce(get("conclusion"), F.lit("pending")), "status": F.coalesce(get("status"), F.lit("unknown")), "run_number": number("run_number"), "run_attempt": attempt, "event_trigger": F.coalesce(get("event"), F.lit("manual"))} | {n: get(n) for n in ("display_title", "path", "head_branch", "html_url")}
    links = [rels(_root(), rel(actor, "User", "triggered_by"), rel(commit, "Commit", "tests_commit"), rel(oid("branch", get("head_branch")), "Branch", "ran_on_branch", False)), each(items("pull_requests"), lambda p: rel(oid("pr", get("number", p)), "PullRequest", "validates_pr", False))]
    seconds = scalars.duration_s(start, end)
    events = [event("WorkflowRunStarted", start, rels(rel(me, "WorkflowRun", "run_started"), _context(), rel(actor, "User", "actor"), rel(commit, "Commit", "on_commit")), trigger=attrs["event_trigger"], attempt=attempt, head_branch=get("head_branch")), event("WorkflowRunCompleted", end, rels(rel(me, "WorkflowRun", "run_completed"), _context()), done, conclusion=get("conclusion"), duration_seconds=seconds, attempt=attempt)]
    return Kind(me, "WorkflowRun", attrs, links, events)


def _workflow_job() -> Kind:
    me, run = oid("job", get("id")), oid("workflow", get("__run_id"))
    known = lambda p: F.when(~get(p).startswith("0001-01-01"), time(p))
    end = known("completed_at")
    begun = known("started_at")
    start = F.when(end.isNull() | (scalars.parsed(begun) <= scalars.parsed(end)), begun)
    seconds = scalars.duration_s(start, end)
    attrs = {"name": get("name"), "runner_name": get("runner_name"), "status": F.coalesce(get("status"), F.lit("unknown")), "conclusion": F.coalesce(get("conclusion"), F.lit("pending")), "duration_seconds": seconds}
    about = lambda q: rels(rel(me, "WorkflowJob", q), rel(run, "WorkflowRun", "job_of_run"))
    return Kind(me, "WorkflowJob", attrs, [rels(rel(run, "WorkflowRun", "job_of_run"))], [event("WorkflowJobStarted", start, about("job_execution"), source="rest_api"), event("WorkflowJobCompleted", end, about("job_completed"), conclusion=get("conclusion"), duration_seconds=seconds)])


def _discussion() -> Kind:
    me = oid("discussion", get("number"))
    attrs = {"number": get("number"), "title": scalars.shortened(get("title"), 255), "url": get("url"), "locked": flag("locked"), "category": get("category.name"), "body_length": F.length(F.coalesce(get("bodyText"), F.lit(""))), "upvote_count": number("upvoteCount"), "reactions_count": _counts("reactions"), "comments_total": _counts("comments"), "comments_overflow": (_counts("comments").cast("bigint") > F.size(items("comments.nodes"))).cast("int"), "updated_at": time("updatedAt")}
    answered = event("DiscussionAnswered", F.when(get("answerChosenAt").isNotNull(), time("answerChosenAt")), rels(rel(me, "Discussion", "subject"), _context(), rel(user("answerChosenBy.login"), "User", "actor")), source="graphql")
    labels = each(items("labels.nodes"), lambda x: rel(oid("label", get("id", x)), "Label", "has_label"))
    return Kind(me, "Discussion", attrs, [rels(_root(), rel(user("author.login"), "User", "created_by")), labels], [_opened(me, "Discussion", time("createdAt"), "DiscussionCreated", source="graphql"), answered])


def _commit_files(most: int | None = None) -> Kind:
    """The files of a commit: all, or the first ``most``."""
    me = oid("commit", get("sha"))
    files = items("files") if most is None else F.slice(items("files"), 1, most)
    links = [each(files, lambda f: rel(oid("file", get("path", f)), "File", F.concat(F.lit("modifies_file_"), F.coalesce(get("status", f), F.lit("modified"))))), each(files, lambda f: rel(oid("file", get("previous_path", f)), "File", "modifies_file_renamed_from"))]
    return Kind(me, "Commit", {"verification_reason": get("verification_reason"), "diff_total": number("stats.total")}, links, owns=False)


def _repository() -> Kind:
    return Kind(repo(), "Repository", {n: get(n) for n in ("name", "description", "url", "created_at", "updated_at", "default_branch", "language", "stars", "forks", "open_issues", "license")})


KINDS: dict[str, Callable[[], Kind]] = {
    "repository": _repository, "milestone": _milestone, "branch": _branch, "tag": _tag, "issue": _issue, "pull_request": _pull_request, "commit": _commit, "commit_of_pr": _commit_of_pr, "commit_files": _commit_files,
    "issue_comment": lambda: _comment("issue"), "pr_comment": lambda: _comment("pr"), "review_comment": lambda: _comment("review"), "discussion_comment": lambda: _comment("discussion"),
    "review": _review, "review_thread": _review_thread, "thread_comment": _thread_comment, "timeline": _timeline, "release": _release, "deployment": _deployment, "workflow_run": _workflow_run, "workflow_job": _workflow_job, "discussion": _discussion,
}


def nested(nodes: DataFrame) -> DataFrame:
    """The nodes and those that they hold: review comments, thread comments, jobs, discussion comments and replies, and the
    pull requests of commits. What a child needs of its parent is put into its JSON."""

    def inside(kind: str, path: str, new: str, **carried: str) -> DataFrame:
        rows = nodes.filter(F.col("kind") == kind).select("repo", "seq", F.explode(items(path)).alias("child"), *[get(p).alias(n) for n, p in carried.items()])
        more = F.concat(*[x for n in carried for x in (F.lit(f'"{n}":"'), F.coalesce(F.col(n), F.lit("")), F.lit('",'))])
        return rows.filter("child is not null").select("repo", F.lit(new).alias("kind"), F.concat(F.lit("{"), more, F.expr("substring(child, 2)")).alias("node"), "seq")

    if "seq" not in nodes.columns:
        nodes = nodes.withColumn("seq", F.lit(0))
    out = nodes = nodes.select("repo", "kind", "node", F.col("seq").cast("bigint").alias("seq"))
    out = out.unionByName(inside("review", "comments.nodes", "review_comment", __review_id="id", __pr_number="__pr_number"))
    out = out.unionByName(inside("review_thread", "comments.nodes", "thread_comment", __thread_id="id", __pr_number="__pr_number"))
    out = out.unionByName(inside("workflow_run", "extracted_jobs", "workflow_job", __run_id="id"))
    out = out.unionByName(inside("commit", "associatedPullRequests.nodes", "commit_of_pr", __commit="oid"))
    talk = inside("discussion", "comments.nodes", "discussion_comment", __discussion_number="number")
    replies = talk.select("repo", "seq", get("__discussion_number").alias("n"), get("id").alias("parent"), F.explode(items("replies.nodes")).alias("child"))
    answer = F.concat(F.lit('{"__discussion_number":"'), "n", F.lit('","__reply_to":"'), "parent", F.lit('",'), F.expr("substring(child, 2)"))
    return out.unionByName(talk).unionByName(replies.select("repo", F.lit("discussion_comment").alias("kind"), answer.alias("node"), "seq"))


def _facts(nodes: DataFrame, name: str, files: int | None = None) -> DataFrame:
    k = _commit_files(files) if name == "commit_files" else KINDS[name]()
    bag = F.map_filter(F.map_from_arrays(F.array(*[F.lit(a) for a in k.attrs]), F.array(*[c.cast("string") for c in k.attrs.values()])), lambda _, v: v.isNotNull()) if k.attrs else F.lit(None).cast("map<string,string>")
    kind = "struct<activity:string,time:string,attrs:map<string,string>,rels:array<" + _REL + ">>"
    whole = F.array().cast(f"array<{kind}>")
    for e in k.events:
        whole = F.concat(whole, F.array(e))
    if k.many is not None:
        whole = F.concat(whole, k.many)
    links = F.array().cast(f"array<{_REL}>")
    for a in k.links:
        links = F.concat(links, a)
    otype = F.when(_is_pr(), "PullRequest").otherwise("Issue") if name == "timeline" else F.lit(k.otype)
    later = k.later if k.later is not None else F.lit(None).cast("struct<time:string,changed_field:string,attrs:map<string,string>>")
    rows = nodes.filter(F.col("kind") == name).select(k.id.alias("oid"), otype.alias("otype"), F.lit(k.owns).alias("owns"), bag.alias("attrs"), links.alias("links"), F.filter(whole, lambda e: e.isNotNull()).alias("events"), later.alias("later"), "seq")
    return rows.filter("oid is not null")


def assemble(nodes: DataFrame, files: int | None = None) -> ObjectLog:
    """The log of all nodes (repo, kind, node, and optionally seq, the order of ingest); unknown kinds are left out. Repeated
    nodes count once, and of several that describe one object the first write wins, attribute by attribute: that of the
    least seq, and of those the first in the order of its text. ``files`` bounds how many files of a commit are linked
    (None: all). Nodes, facts, objects and what must be settled are written once to the shared folder, since all five tables
    read them."""
    nodes = staged(nested(nodes), "nodes")
    facts = None
    for name in KINDS:
        one = _facts(nodes, name, files)
        facts = one if facts is None else facts.unionByName(one)
    facts = staged(facts, "facts")  # read by each of the tables below
    every = staged(_objects(facts), "objects")
    objects = every.filter("there").select("oid", "otype")
    # What several facts say of an object is settled by joins. A fact that alone describes its object needs none, nor does an
    # event with its own id whose links bring their objects into being. Both stay where they are.
    shared, mixed = (staged(every.filter(c).select("oid"), n) for c, n in (("facts > 1 or mixed", "shared"), ("mixed", "mixed")))
    alone = facts.filter("owns").join(shared, "oid", "left_anti")
    rest = facts.filter("not owns").unionByName(facts.filter("owns").join(shared, "oid", "left_semi"))
    happened = facts.select(F.explode("events").alias("e")).select("e.*").withColumn("rels", F.array_sort("rels"))
    key = F.transform("rels", lambda r: F.concat_ws(":", r["oid"], r["qualifier"]))
    happened = happened.withColumn("eid", F.sha2(F.concat_ws("|", "activity", "time", F.array_join(key, ","), F.coalesce(F.to_json("attrs"), F.lit(""))), 256)).withColumn("_hash", F.xxhash64("eid"))
    odd = happened.select("_hash", F.explode("rels.oid").alias("oid")).join(mixed, "oid", "left_semi").select("_hash")
    odd = staged(repeated(happened, "eid").unionByName(odd).distinct(), "odd")
    plain = ~F.exists("rels", lambda r: ~r["stub"]) & (F.size("rels") > 0) & (F.size(F.array_distinct(_named("rels"))) == F.size("rels"))
    others = happened.filter(~plain).unionByName(happened.filter(plain).join(odd, "_hash", "left_semi")).drop("_hash")
    involved = others.select("eid", "activity", "time", "attrs", F.explode("rels").alias("r")).select("eid", "activity", "time", "attrs", "r.*").drop("otype")
    linked = rest.select(F.col("oid").alias("src"), F.explode("links").alias("r")).select("src", "r.oid", "r.qualifier")
    stubs, asked = (_named(F.filter("links", c)) for c in (lambda r: r["stub"], lambda r: ~r["stub"]))
    asked = alone.select(F.col("oid").alias("src"), F.explode(F.array_except(asked, stubs)).alias("r")).select("src", "r.*")
    sought = involved.select("oid").unionByName(linked.select("oid")).unionByName(asked.select("oid")).unionByName(rest.select("oid")).distinct()
    known = staged(objects.join(staged(sought, "sought"), "oid", "left_semi"), "known")
    names = known.select("oid")
    # Most nodes name the repository, and many one milestone or branch.
    settled = met(involved, known, "oid").groupBy("eid").agg(F.first("activity").alias("activity"), F.first("time").alias("time"), F.first("attrs").alias("attrs"), F.collect_set(F.struct("oid", "otype", "qualifier")).alias("rels"))
    rows = happened.filter(plain).join(odd, "_hash", "left_anti").withColumn("rels", F.transform("rels", lambda r: F.struct(r["oid"], r["otype"], r["qualifier"])))
    rows = rows.select(*settled.columns).unionByName(settled).select("eid", "activity", F.try_to_timestamp("time").alias("ts"), "attrs", "rels")
    e2o = rows.select("eid", F.explode("rels").alias("r")).select("eid", "r.*")
    o2o = met(linked, names, "oid", "left_semi").join(names.withColumnRenamed("oid", "src"), "src", "left_semi").select("src", "oid", "qualifier").distinct()
    o2o = o2o.unionByName(alone.select(F.col("oid").alias("src"), F.explode(F.array_distinct(stubs)).alias("r")).select("src", "r.*")).unionByName(met(asked, names, "oid", "left_semi").select("src", "oid", "qualifier"))
    o2o = o2o.withColumnsRenamed({"src": "src_oid", "oid": "tgt_oid"}).unionByName(retries(facts, objects))
    said = rest.filter("attrs is not null").join(names, "oid", "left_semi").select("oid", "seq", F.explode("attrs").alias("name", "value"))
    first = said.groupBy("oid", "name").agg(F.min_by("value", F.struct("seq", "value")).alias("value")).groupBy("oid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("attrs"))
    first = first.join(known, "oid").select("oid", "otype", "attrs").unionByName(alone.filter(F.size("attrs") > 0).select("oid", "otype", F.map_from_entries(F.array_sort(F.map_entries("attrs"))).alias("attrs")))
    static = first.select("oid", "otype", F.to_timestamp(F.lit(EPOCH)).alias("ts"), F.lit(None).cast("string").alias("changed_field"), "attrs")
    partial = facts.filter("later is not null").select("oid", "otype", F.try_to_timestamp("later.time").alias("ts"), F.col("later.changed_field").alias("changed_field"), F.col("later.attrs").alias("attrs"))
    return ObjectLog.of(rows.select("eid", "activity", "ts", "attrs"), objects, e2o, o2o, static.unionByName(partial.dropDuplicates(["oid", "ts", "changed_field"]))).with_rows(rows)


def _named(links: Column | str) -> Column:
    return F.transform(links, lambda r: F.struct(r["oid"], r["qualifier"]))


def _objects(facts: DataFrame) -> DataFrame:
    """oid, otype, there, mixed, facts: of each id that a fact or a link names its type (that of a node goes before that of a
    link, and of several the least one), whether it is an object, whether it is said to be of several types, and its facts."""
    none = F.array().cast(f"array<{_REL}>")
    links = F.concat(F.coalesce("links", none), F.coalesce(F.flatten("events.rels"), none))
    # Links of a node to itself say no more than the node.
    stubs = F.filter(links, lambda r: r["stub"] & ~(F.col("owns") & r["oid"].eqNullSafe(F.col("oid")) & r["otype"].eqNullSafe(F.col("otype"))))
    said = facts.select("oid", F.when(F.col("owns"), F.col("otype")).alias("otype"), F.col("owns").alias("there"), F.col("owns").alias("node"), F.lit(1).alias("one"))
    said = said.unionByName(facts.select(F.explode(stubs).alias("r")).select("r.oid", "r.otype", F.lit(True).alias("there"), F.lit(False).alias("node"), F.lit(0).alias("one")))
    types = F.when(F.col("there"), F.coalesce("otype", F.lit("")))
    found = said.groupBy("oid").agg(F.min(F.when(F.col("there"), F.struct(~F.col("node"), "otype"))).alias("type"), F.max("there").alias("there"), (F.min(types) != F.max(types)).alias("mixed"), F.sum("one").alias("facts"))
    return found.select("oid", "type.otype", "there", F.coalesce("mixed", F.lit(False)).alias("mixed"), "facts")


def retries(facts: DataFrame, objects: DataFrame) -> DataFrame:
    """Attempt n of a workflow's run to its attempt n - 1; workflows that share a run number stay apart."""
    runs = facts.filter("otype = 'WorkflowRun' and owns").select("oid", F.col("attrs")["name"].alias("name"), F.col("attrs")["run_number"].alias("run"), F.col("attrs")["run_attempt"].cast("int").alias("attempt")).distinct()
    before = runs.select(F.col("oid").alias("tgt_oid"), "name", "run", (F.col("attempt") + 1).alias("attempt"))
    return runs.join(before, ["name", "run", "attempt"]).select(F.col("oid").alias("src_oid"), "tgt_oid", F.lit("retry_of").alias("qualifier"))


def unread_commits(nodes: DataFrame) -> DataFrame:
    """repo, pr_number, oid: commits that pull requests name and no commit node describes, such as those of branches that
    were never merged. `assemble` links them as stubs."""
    pulls = nodes.filter("kind = 'pull_request'").select("repo", get("number").alias("pr_number"), F.explode(items("commits.nodes")).alias("c"))
    named = pulls.select("repo", "pr_number", F.coalesce(get("commit.oid", F.col("c")), get("oid", F.col("c"))).alias("oid"))
    named = named.unionByName(nodes.filter("kind = 'commit_of_pr'").select("repo", get("number").alias("pr_number"), get("__commit").alias("oid")))
    read = nodes.filter("kind = 'commit'").select("repo", get("oid").alias("oid"))
    return named.filter("oid is not null").distinct().join(read, ["repo", "oid"], "left_anti").select("repo", "pr_number", "oid")
