"""Every kind of node once, and the cases in which mapping a node at a time used to lose links."""

import json

import pytest

from objectlog.operators import validate
from objectlog.sources import mappers

T = "2024-01-0{}T00:00:00Z".format
NODES = [
    ("repository", {"name": "r"}),
    ("milestone", {"id": "M1", "number": 1, "state": "CLOSED", "createdAt": T(1), "closedAt": T(3), "updatedAt": T(4), "pullRequests": {"totalCount": 1}, "mergedPRs": {"totalCount": 2}, "closedUnmergedPRs": {"totalCount": 1}, "creator": {"login": "ann"}}),
    ("branch", {"id": "B", "name": "main", "target": {"oid": "c0ffee", "committedDate": T(1), "author": {"user": {"login": "ann"}}}}),
    ("tag", {"id": "T1", "name": "v1.2.0", "date": T(2), "commit": {"sha": "c0ffee"}, "tagger": {"login": "ann"}}),
    ("issue", {"number": 7, "id": "I7", "title": "x" * 300, "createdAt": T(1), "author": {"login": "bob"}, "assignees": {"nodes": [{"login": "ann"}]}, "labels": {"nodes": [{"id": "L1", "name": "bug"}]}, "milestone": {"id": "M1"}, "reactionGroups": [{"content": "HEART", "reactors": {"totalCount": 2}}, {"content": "CONFUSED", "reactors": {"totalCount": 1}}]}),
    ("pull_request", {"number": 9, "createdAt": T(1), "updatedAt": T(2), "author": {"login": "ann"}, "baseRefName": "main", "headRefName": "gone", "statusCheckRollup": {"state": "SUCCESS"}, "additions": 3, "deletions": 4}),
    ("commit", {"oid": "abc", "message": "feat(api)!: x\n\nFixes #7 and #99", "committedDate": T(2), "author": {"user": {"login": "ann"}}, "committer": {"name": "web"}, "associatedPullRequests": {"nodes": [{"number": 9}]}, "checkSuites": {"nodes": [{"status": "COMPLETED", "conclusion": "FAILURE", "workflowRun": {"databaseId": 55}}, {"status": "QUEUED"}]}}),
    ("commit_files", {"sha": "abc", "files": [{"path": "a.py", "status": "renamed", "previous_path": "b.py"}], "stats": {"total": 5}}),
    ("issue_comment", {"id": "C1", "__issue_number": 7, "createdAt": T(2), "lastEditedAt": T(3), "author": {"login": "bot", "__typename": "Bot"}}),
    ("review", {"id": "R1", "__pr_number": 9, "state": "APPROVED", "submittedAt": T(3), "author": {"login": "bob"}, "commit": {"oid": "abc"}, "comments": {"totalCount": 1, "nodes": [{"id": "C2", "createdAt": T(3), "path": "a.py", "author": {"login": "bob"}}]}}),
    ("review_thread", {"id": "TH", "__pr_number": 9, "isResolved": True, "resolvedBy": {"login": "ann"}, "comments": {"nodes": [{"id": "C2", "createdAt": T(4), "replyTo": {"id": "C1"}}]}}),
    ("review_thread", {"id": "TH2", "__pr_number": 9, "isResolved": False, "comments": {"nodes": []}}),
    ("release", {"databaseId": 5, "tagName": "v1.2.0", "createdAt": T(2), "publishedAt": T(3), "tag": {"id": "T1", "target": {"__typename": "Commit", "oid": "abc"}}, "releaseAssets": {"nodes": [{"downloadCount": 3}, {"downloadCount": 4}]}}),
    ("deployment", {"databaseId": 3, "createdAt": T(4), "ref": {"name": "lost"}, "statuses": {"nodes": [{"state": "SUCCESS", "createdAt": T(5)}, {"state": "QUEUED", "createdAt": T(5)}]}}),
    ("workflow_run", {"id": 55, "name": "ci", "run_number": 1, "run_attempt": 1, "status": "completed", "run_started_at": T(2), "updated_at": T(3), "head_sha": "abc", "extracted_jobs": [{"id": 1, "started_at": T(2), "completed_at": T(3)}, {"id": 2, "started_at": T(2)}, {"id": 3, "started_at": "0001-01-01T00:00:00Z"}]}),
    ("workflow_run", {"id": 56, "name": "ci", "run_number": 1, "run_attempt": 2, "status": "queued", "created_at": T(4)}),
    ("workflow_run", {"id": 57, "name": "lint", "run_number": 1, "run_attempt": 1, "status": "queued", "created_at": T(4)}),
    ("discussion", {"number": 4, "createdAt": T(1), "author": {"login": "ann"}, "answerChosenAt": T(5), "comments": {"nodes": [{"id": "D1", "createdAt": T(2), "replies": {"nodes": [{"id": "D2", "createdAt": T(3)}]}}]}}),
] + [
    ("timeline", {"__typename": k, "__parent_type": p, n: v, "createdAt": T(5), "actor": {"login": "ann"}, **more})
    for k, p, n, v, more in [
        ("AssignedEvent", "Issue", "__issue_number", 7, {"assignee": {"login": "bob"}}), ("UnassignedEvent", "PullRequest", "__pr_number", 9, {}), ("ReviewRequestedEvent", "PullRequest", "__pr_number", 9, {"requestedReviewer": {"__typename": "Team", "name": "core"}}),
        ("ReviewRequestRemovedEvent", "PullRequest", "__pr_number", 9, {}), ("ReadyForReviewEvent", "PullRequest", "__pr_number", 9, {}), ("ConvertToDraftEvent", "PullRequest", "__pr_number", 9, {}), ("LabeledEvent", "Issue", "__issue_number", 7, {"label": {"id": "L2", "name": "new"}}),
        ("UnlabeledEvent", "Issue", "__issue_number", 7, {}), ("MilestonedEvent", "Issue", "__issue_number", 7, {}), ("DemilestonedEvent", "Issue", "__issue_number", 7, {}), ("ClosedEvent", "Issue", "__issue_number", 7, {"closer": {"__typename": "PullRequest", "number": 9}}),
        ("ReopenedEvent", "Issue", "__issue_number", 7, {}), ("MergedEvent", "PullRequest", "__pr_number", 9, {"commit": {"oid": "abc"}, "mergeRefName": "main", "__pr_head_ref": "gone"}), ("HeadRefForcePushedEvent", "PullRequest", "__pr_number", 9, {}),
        ("HeadRefDeletedEvent", "PullRequest", "__pr_number", 9, {"__pr_head_ref": "gone"}), ("HeadRefRestoredEvent", "PullRequest", "__pr_number", 9, {"__pr_head_ref": "gone"}), ("DeployedEvent", "PullRequest", "__pr_number", 9, {"deployment": {"databaseId": 8}}),
        ("CrossReferencedEvent", "Issue", "__issue_number", 7, {"source": {"__typename": "PullRequest", "number": 9}}), ("ConnectedEvent", "Issue", "__issue_number", 7, {"subject": {"__typename": "PullRequest", "number": 9}}), ("DisconnectedEvent", "Issue", "__issue_number", 7, {}),
        ("UnheardOfEvent", "Issue", "__issue_number", 7, {}), ("ClosedEvent", "Issue", "__issue_number", 12345, {}),
    ]
]


@pytest.fixture(scope="module")
def log(spark):
    rows = [("own_r", k, json.dumps(n)) for k, n in NODES]
    made = mappers.assemble(spark.createDataFrame(rows + rows[:5], "repo string, kind string, node string"))
    cached = {k: getattr(made, k).cache() for k in ("events", "objects", "e2o", "o2o", "changes")}
    return type(made)(**cached, event_types=made.event_types, object_types=made.object_types)


def test_events(log):
    n = {r.activity: r["count"] for r in log.events.groupBy("activity").count().collect()}
    once = "IssueAssigned PRUnassigned PRReviewRequested PRReviewRequestRemoved PRReadyForReview PRConvertedToDraft LabelAdded LabelRemoved MilestoneAssigned MilestoneRemoved IssueReopened PRMerged BranchMerged PRForcePushed BranchDeleted BranchRestored CrossReferenced IssueLinked IssueUnlinked"
    for a in once.split() + "MilestoneCreated MilestoneClosed MilestoneUpdated BranchSnapshot TagCreated IssueOpened PROpened PRCIState CommitCreated PRReviewApproved ReviewThreadResolved ReleaseCreated ReleasePublished DeploymentSucceeded WorkflowRunCompleted DiscussionCreated DiscussionAnswered".split():
        assert n.get(a) == 1, (a, n.get(a))
    assert n["DeploymentCreated"] == 2 and n["CommentCreated"] == 4 and n["CommentEdited"] == 1 and n["WorkflowRunStarted"] == 3
    # A running job has started and not ended; one without times has no event at all.
    assert n["WorkflowJobStarted"] == 2 and n["WorkflowJobCompleted"] == 1
    closed = log.events.filter("activity = 'IssueClosed'").join(log.e2o.filter("qualifier = 'subject'"), "eid").collect()
    assert [r.oid for r in closed] == ["own_r_issue_7"]


def test_links(log):
    got = {(r.src_oid, r.qualifier, r.tgt_oid) for r in log.o2o.collect()}
    p = "own_r_"
    for s, q, t in [
        ("issue_7", "has_label", "label_L1"), ("issue_7", "has_label", "label_L2"), ("issue_7", "belongs_to_milestone", "milestone_M1"), ("issue_7", "closed_by", "pr_9"), ("issue_7", "references", "pr_9"), ("issue_7", "linked_issue", "pr_9"),
        ("pr_9", "targets_branch", "branch_main"), ("pr_9", "source_branch", "branch_gone"), ("pr_9", "contains_commit", "commit_abc"), ("commit_abc", "references_issue", "issue_7"), ("commit_abc", "tested_by", "workflow_55"),
        ("commit_abc", "modifies_file_renamed", "file_a.py"), ("commit_abc", "modifies_file_renamed_from", "file_b.py"), ("release_5", "tagged_as", "tag_T1"), ("deployment_3", "deployed_from_branch", "branch_lost"), ("workflow_56", "retry_of", "workflow_55"), ("comment_D2", "replies_to", "comment_D1"), ("job_1", "job_of_run", "workflow_55"),
    ]:
        assert (p + s, q, p + t) in got, (s, q, t)
    assert not any(t.endswith("issue_99") for _, _, t in got) and (p + "workflow_56", "retry_of", p + "workflow_57") not in got


def test_attributes_and_integrity(log):
    at = {r.oid: r.attrs for r in log.changes.filter("changed_field is null").collect()}
    assert len(at["own_r_issue_7"]["title"]) == 255 and at["own_r_issue_7"]["reactions_positive"] == "2" and at["own_r_issue_7"]["reactions_negative"] == "1"
    assert at["own_r_commit_abc"]["commit_type"] == "feat" and at["own_r_commit_abc"]["is_breaking"] == "true" and at["own_r_commit_abc"]["diff_total"] == "5"
    assert at["own_r_milestone_M1"]["rejection_rate_pct"] == "25.0" and at["own_r_release_5"]["total_downloads"] == "7" and at["own_r_tag_T1"]["minor"] == "2"
    assert [r.attrs["state"] for r in log.changes.filter("changed_field = 'state'").collect()] == ["CLOSED"]
    assert validate.semantics(log).count() == 0


def _nodes(spark, rows):
    return spark.createDataFrame([(r, k, json.dumps(n), q) for r, k, n, q in rows], "repo string, kind string, node string, seq long")


def test_raw_tags_and_plain_ones(spark):
    light = {"id": "T1", "name": "v1.2.3", "target": {"__typename": "Commit", "oid": "c1", "committedDate": "2024-01-01T00:00:00Z", "author": {"name": "Ann", "user": {"login": "ann"}}, "signature": {"isValid": True}, "statusCheckRollup": {"state": "SUCCESS"}, "associatedPullRequests": {"totalCount": 2}}}
    annotated = {"id": "T2", "name": "v2.0.0", "target": {"__typename": "Tag", "message": "two", "tagger": {"name": "Bob", "date": "2024-02-01T00:00:00Z"}, "target": {"oid": "c2"}}}
    plain = {"id": "T3", "name": "x", "date": "2024-03-01T00:00:00Z", "tagger": {"email": "e@x"}, "commit": {"sha": "c3"}, "is_annotated": 1}
    tree = {"id": "T4", "name": "tree", "target": {"__typename": "Tree", "oid": "t"}}
    log = mappers.assemble(_nodes(spark, [("r", "tag", n, 0) for n in (light, annotated, plain, tree)]))
    attrs = {r.oid: r.attrs for r in log.changes.filter("otype = 'Tag'").collect()}
    got = {a["name"]: (a["is_annotated"], a.get("message"), a["is_signed"], a.get("ci_state"), a["release_pr_count"]) for a in attrs.values()}
    assert got == {"v1.2.3": ("0", None, "1", "SUCCESS", "2"), "v2.0.0": ("1", "two", "0", None, "0"), "x": ("1", None, "0", None, "0")}
    assert sorted(str(r.ts)[:10] for r in log.events.filter("activity = 'TagCreated'").collect()) == ["2024-01-01", "2024-02-01", "2024-03-01"]
    assert {r.qualifier for r in log.o2o.collect()} >= {"tags_commit", "created_by"} and log.o2o.filter("qualifier = 'tags_commit'").count() == 3


def test_first_write_files_and_unread_commits(spark):
    files = {"sha": "c1", "files": [{"path": f"f{k}"} for k in range(130)]}
    rows = [("r", "commit", {"oid": "c1", "message": "zz"}, 1), ("r", "commit", {"oid": "c1", "message": "aa"}, 2), ("r", "commit_files", files, 3), ("r", "pull_request", {"number": 1, "commits": {"nodes": [{"commit": {"oid": "c1"}}, {"commit": {"oid": "c9"}}]}}, 4)]
    rows.append(("r", "discussion", {"number": 4, "comments": {"totalCount": 60, "nodes": [{"id": "x"}]}}, 5))
    nodes = _nodes(spark, rows)
    log = mappers.assemble(nodes)
    said = {r.otype: r.attrs for r in log.changes.collect()}
    assert said["Commit"]["message"] == "zz" and said["Discussion"]["comments_overflow"] == "1"
    assert log.objects.filter("otype = 'File'").count() == 130 and mappers.assemble(nodes, files=100).objects.filter("otype = 'File'").count() == 100
    assert [tuple(r) for r in mappers.unread_commits(nodes).collect()] == [("r", "1", "c9")]
    assert log.o2o.filter("qualifier = 'contains_commit'").count() == 2
