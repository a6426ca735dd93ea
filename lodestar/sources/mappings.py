"""Raw payloads of three kinds of systems to document events and edges: projections over typed structs.

Every mapping takes a DataFrame with the payload's columns and now_ms (the time of the crawl or delivery) and gives rows of (op, doc, version, src_ts_ms, emit_ts_ms, mode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import duplicates_named, epoch_ms, fnv1a64, iso_time, jira_time, message_title, number_after_slash, seeded, slack_micros
from ..schemas import EVERYONE, blank

GITHUB_ISSUE = "number long, title string, body string, state string, html_url string, user struct<login:string>, labels array<struct<name:string>>, created_at string, updated_at string, pull_request struct<url:string>"
GITHUB_COMMENT = "id long, body string, html_url string, issue_url string, user struct<login:string>, created_at string, updated_at string"
GITHUB_HOOK = f"action string, repository struct<full_name:string>, issue struct<{GITHUB_ISSUE.replace(' string', ':string').replace(' long', ':long').replace(' struct', ':struct').replace(' array', ':array')}>, pull_request struct<{GITHUB_ISSUE.replace(' string', ':string').replace(' long', ':long').replace(' struct', ':struct').replace(' array', ':array')}>, comment struct<{GITHUB_COMMENT.replace(' string', ':string').replace(' long', ':long').replace(' struct', ':struct')}>"
_JIRA_PERSON = "struct<name:string,displayName:string>"
_JIRA_COMMENT = f"struct<id:string,body:string,author:{_JIRA_PERSON},created:string,updated:string>"
JIRA_ISSUE = (
    "key string, fields struct<summary:string,description:string,labels:array<string>,issuetype:struct<name:string>,status:struct<name:string>,"
    f"reporter:{_JIRA_PERSON},created:string,updated:string,issuelinks:array<struct<type:struct<name:string>,outwardIssue:struct<key:string>,inwardIssue:struct<key:string>>>,"
    f"comment:struct<comments:array<{_JIRA_COMMENT}>,total:int>>"
)
_SLACK_MESSAGE = "user:string,text:string,ts:string,thread_ts:string,subtype:string,edited:struct<ts:string>"
SLACK_EVENT = f"type string, subtype string, channel string, user string, text string, ts string, thread_ts string, deleted_ts string, message struct<{_SLACK_MESSAGE}>"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _strings(c: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return none if c is None else F.coalesce(c, none)


def _doc(**columns: Column) -> Column:
    names = ("id", "datasource", "container", "kind", "title", "body", "url", "author", "parent_id", "labels", "duplicates", "created_at", "updated_at", "allowed")
    lists = ("labels", "duplicates", "allowed")
    times = ("created_at", "updated_at")
    return F.struct(*[columns.get(c, _strings() if c in lists else F.lit(None).cast("string") if c in times else F.lit("")).alias(c) for c in names])


def _event(op: str, doc: Column, version: Column, src: Column, mode: str | Column) -> list[Column]:
    return [F.lit(op).alias("op"), doc.alias("doc"), version.cast("long").alias("version"), src.cast("long").alias("src_ts_ms"), F.col("now_ms").alias("emit_ts_ms"), (F.lit(mode) if isinstance(mode, str) else mode).alias("mode")]


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


# Trackers with repositories.


def github_issues(raw: DataFrame, mode: str = "live") -> DataFrame:
    """raw: repo, now_ms and an issue's columns. The version is the time of the last update."""
    container = F.concat(F.lit("github:"), "repo")
    labels = F.concat(_strings(F.transform("labels", lambda x: x["name"])), F.when(blank(F.col("state")), _strings()).otherwise(F.array(F.concat(F.lit("state:"), "state"))))
    updated, created = iso_time(F.col("updated_at")), iso_time(F.col("created_at"))
    doc = _doc(
        id=F.concat(container, F.lit("#"), F.col("number").cast("string")), datasource=F.lit("github"), container=container, kind=F.when(F.col("pull_request").isNotNull(), "pull_request").otherwise("issue"),
        title=_text("title"), body=_text("body"), url=_text("html_url"), author=_text("user.login"), labels=labels, created_at=_iso(created), updated_at=_iso(updated), allowed=F.array(F.concat(F.lit("c:"), container)),
    )
    return raw.select(*_event("upsert", doc, epoch_ms(updated), epoch_ms(updated), mode))


def github_comments(raw: DataFrame, titles: DataFrame | None, mode: str = "live") -> DataFrame:
    """raw: repo, now_ms and a comment's columns; titles: (repo, number, issue_title), one each, or None if raw has issue_title. A title that isn't known is repo#number."""
    j = raw.withColumn("number", number_after_slash(F.col("issue_url")))
    j = j if titles is None else j.join(titles.select("repo", "number", "issue_title"), ["repo", "number"], "left")
    container, number = F.concat(F.lit("github:"), "repo"), F.col("number").cast("string")
    issue = F.concat(container, F.lit("#"), number)
    named = F.filter(F.transform(duplicates_named(F.col("body")), lambda n: n.try_cast("long")), lambda n: n.isNotNull() & (n != F.col("number")))
    updated, created = iso_time(F.col("updated_at")), iso_time(F.col("created_at"))
    title = F.when(blank(F.col("issue_title")), F.concat("repo", F.lit("#"), number)).otherwise(F.col("issue_title"))
    doc = _doc(
        id=F.concat(issue, F.lit("/c"), F.col("id").cast("string")), datasource=F.lit("github"), container=container, kind=F.lit("comment"), title=F.concat(F.lit("Re: "), title), body=_text("body"), url=_text("html_url"), author=_text("user.login"),
        parent_id=issue, duplicates=F.transform(named, lambda n: F.concat(container, F.lit("#"), n.cast("string"))), created_at=_iso(created), updated_at=_iso(updated), allowed=F.array(F.concat(F.lit("c:"), container)),
    )
    return j.select(*_event("upsert", doc, epoch_ms(updated), epoch_ms(updated), mode))


def _after(now: Column, updated: Column) -> Column:
    """A deletion's version: now, or just after the last update."""
    return F.greatest(now, epoch_ms(updated) + 1)


def github_hooks(deliveries: DataFrame) -> DataFrame:
    """deliveries: event (the header), body (JSON), now_ms. Issues, pull requests and comments; deleted and transferred ones become deletes; anything else gives nothing."""
    d = deliveries.withColumn("h", F.from_json("body", GITHUB_HOOK)).withColumn("repo", F.col("h.repository.full_name"))
    issue = [F.col(f"h.issue.{c.strip().split(' ')[0]}") for c in ("number", "title", "body", "state", "html_url", "user", "labels", "created_at", "updated_at", "pull_request")]
    gone = F.col("h.action").isin("deleted", "transferred")
    issues = d.filter((F.col("event") == "issues") & F.col("h.issue").isNotNull())
    out = github_issues(issues.filter(~F.coalesce(gone, F.lit(False))).select("repo", "now_ms", *issue))
    pulls = d.filter((F.col("event") == "pull_request") & F.col("h.pull_request").isNotNull())
    out = out.unionByName(github_issues(pulls.select("repo", "now_ms", "h.pull_request.*").withColumn("pull_request", F.coalesce("pull_request", F.struct(F.lit("").alias("url"))))))
    comments = d.filter((F.col("event") == "issue_comment") & F.col("h.comment").isNotNull() & F.col("h.issue").isNotNull())
    kept = comments.filter(~F.col("h.action").eqNullSafe("deleted"))
    # Each delivery names its own issue's title.
    out = out.unionByName(github_comments(kept.select("repo", "now_ms", F.col("h.issue.title").alias("issue_title"), "h.comment.*"), None))
    container = F.concat(F.lit("github:"), "repo")
    base = F.concat(container, F.lit("#"), F.col("h.issue.number").cast("string"))
    deletes = issues.filter(gone).select("now_ms", base.alias("id"), container.alias("container"), F.col("h.issue.updated_at").alias("at"))
    deletes = deletes.unionByName(comments.filter(F.col("h.action") == "deleted").select("now_ms", F.concat(base, F.lit("/c"), F.col("h.comment.id").cast("string")).alias("id"), container.alias("container"), F.col("h.comment.updated_at").alias("at")))
    return out.unionByName(_deletes(deletes, "github", iso_time(F.col("at"))))


def _deletes(rows: DataFrame, datasource: str, updated: Column) -> DataFrame:
    doc = _doc(id=F.col("id"), datasource=F.lit(datasource), container=F.col("container"))
    return rows.select(*_event("delete", doc, _after(F.col("now_ms"), updated), F.col("now_ms"), "live"))


# Trackers with projects.


def jira_issues(raw: DataFrame, base: str, mode: str = "live") -> DataFrame:
    """raw: now_ms and an issue's columns (key, fields). base: the address that links start with."""
    f = "fields."
    project = F.concat(F.lit("jira:"), F.substring_index("key", "-", 1))

    def named(prefix, c):
        return F.when(blank(F.col(f + c)), _strings()).otherwise(F.array(F.concat(F.lit(prefix), F.col(f + c))))

    links = F.filter(F.coalesce(F.col(f + "issuelinks"), F.array().cast("array<struct<type:struct<name:string>,outwardIssue:struct<key:string>,inwardIssue:struct<key:string>>>")), lambda x: (x["type"]["name"] == "Duplicate") & ~blank(x["outwardIssue"]["key"]))
    updated, created = jira_time(F.col(f + "updated")), jira_time(F.col(f + "created"))
    doc = _doc(
        id=F.concat(F.lit("jira:"), "key"), datasource=F.lit("jira"), container=project, kind=F.lit("issue"), title=_text(f + "summary"), body=_text(f + "description"), url=F.concat(F.lit(base.rstrip("/") + "/browse/"), "key"), author=_text(f + "reporter.displayName"),
        labels=F.concat(_strings(F.col(f + "labels")), named("type:", "issuetype.name"), named("status:", "status.name")), duplicates=F.transform(links, lambda x: F.concat(F.lit("jira:"), x["outwardIssue"]["key"])),
        created_at=_iso(created), updated_at=_iso(updated), allowed=F.array(F.concat(F.lit("c:"), project)),
    )
    return raw.select(*_event("upsert", doc, epoch_ms(updated), epoch_ms(updated), mode))


def jira_comments(raw: DataFrame, base: str, mode: str = "live") -> DataFrame:
    c = raw.select("key", "now_ms", F.col("fields.summary").alias("summary"), F.explode("fields.comment.comments").alias("c"))
    project = F.concat(F.lit("jira:"), F.substring_index("key", "-", 1))
    updated, created = jira_time(F.col("c.updated")), jira_time(F.col("c.created"))
    url = F.concat(F.lit(base.rstrip("/") + "/browse/"), "key", F.lit("?focusedCommentId="), "c.id", F.lit("#comment-"), "c.id")
    doc = _doc(
        id=F.concat(F.lit("jira:"), "key", F.lit("/c"), "c.id"), datasource=F.lit("jira"), container=project, kind=F.lit("comment"), title=F.concat(F.lit("Re: "), _text("summary")), body=_text("c.body"), url=url, author=_text("c.author.displayName"),
        parent_id=F.concat(F.lit("jira:"), "key"), created_at=_iso(created), updated_at=_iso(updated), allowed=F.array(F.concat(F.lit("c:"), project)),
    )
    return c.select(*_event("upsert", doc, epoch_ms(updated), epoch_ms(updated), mode))


def vanished_comments(before: DataFrame, raw: DataFrame) -> DataFrame:
    """Deletes of the comments in before (key, comment_id) that the issues in raw no longer have; issues that weren't crawled keep theirs."""
    # All that is known of an issue meets in one join by its key; an issue that was crawled twice has the comments of both.
    ids = F.coalesce("fields.comment.comments.id", F.array().cast("array<string>"))
    seen = raw.select("key", "now_ms", F.col("fields.updated").alias("updated"), ids.alias("ids"))
    seen = seen.withColumn("ids", F.flatten(F.collect_list("ids").over(Window.partitionBy("key"))))
    gone = before.join(seen, "key").filter(~F.coalesce(F.array_contains("ids", F.col("comment_id")), F.lit(False)))
    project = F.concat(F.lit("jira:"), F.substring_index("key", "-", 1))
    rows = gone.select("now_ms", F.concat(F.lit("jira:"), "key", F.lit("/c"), "comment_id").alias("id"), project.alias("container"), "updated")
    return _deletes(rows, "jira", jira_time(F.col("updated")))


# Chats.


def resolved(users: DataFrame, directory: DataFrame) -> DataFrame:
    """(user, dir_id, name) of chat users (id, real_name, email, is_bot, deleted) by the address in the directory (id, email), letters in either case; unknown ones have no dir_id."""
    by_email = directory.filter(~blank(F.col("email"))).groupBy(F.lower("email").alias("e")).agg(F.max("id").alias("dir_id"))
    people = users.filter(~F.coalesce("is_bot", F.lit(False)) & ~F.coalesce("deleted", F.lit(False))).withColumn("e", F.lower("email"))
    return people.join(by_email, "e", "left").select(F.col("id").alias("user"), "dir_id", F.col("real_name").alias("name"))


def slack_messages(raw: DataFrame, people: DataFrame, channels: DataFrame, workspace: str, mode: str = "live") -> DataFrame:
    """raw: channel, now_ms and a message's columns (user, text, ts, thread_ts, subtype, edited). Joins, topics and the like are left out. channels: (channel, name, is_private)."""
    m = raw.filter(blank(F.col("subtype")) | (F.col("subtype") == "thread_broadcast"))
    m = m.join(people.select("user", F.col("name").alias("p_name")), "user", "left").join(channels.select("channel", F.col("name").alias("c_name")), "channel", "left")
    container = F.concat(F.lit("slack:"), "channel")
    posted, version = slack_micros(F.col("ts")), slack_micros(F.when(blank(F.col("edited.ts")), F.col("ts")).otherwise(F.col("edited.ts")))
    reply = ~blank(F.col("thread_ts")) & (F.col("thread_ts") != F.col("ts"))
    doc = _doc(
        id=F.concat(container, F.lit("/"), "ts"), datasource=F.lit("slack"), container=container, kind=F.lit("message"), title=message_title(F.col("text")), body=_text("text"),
        url=F.concat(F.lit(f"https://{workspace}.slack.com/archives/"), "channel", F.lit("/p"), F.replace("ts", F.lit("."), F.lit(""))), author=F.when(blank(F.col("p_name")), _text("user")).otherwise(F.col("p_name")),
        labels=F.when(blank(F.col("c_name")), _strings()).otherwise(F.array(F.concat(F.lit("#"), "c_name"))), parent_id=F.when(reply, F.concat(container, F.lit("/"), "thread_ts")).otherwise(""),
        created_at=_iso(F.timestamp_micros(posted)), updated_at=_iso(F.timestamp_micros(version)), allowed=F.array(F.concat(F.lit("c:"), container)),
    )
    return m.select(*_event("upsert", doc, version, F.floor(version / 1000), mode))


def slack_events(raw: DataFrame, people: DataFrame, channels: DataFrame, workspace: str) -> DataFrame:
    """raw: now_ms and an event's columns: posts, edits (of the inner message) and deletions."""
    m = raw.filter(F.col("type") == "message")
    plain = m.filter(blank(F.col("subtype")) | (F.col("subtype") == "thread_broadcast")).select("channel", "now_ms", "user", "text", "ts", "thread_ts", "subtype", F.lit(None).cast("struct<ts:string>").alias("edited"))
    edits = m.filter((F.col("subtype") == "message_changed") & F.col("message").isNotNull()).select("channel", "now_ms", *[F.col(f"message.{c}").alias(c) for c in ("user", "text", "ts", "thread_ts")], F.lit("").alias("subtype"), "message.edited")
    gone = m.filter(F.col("subtype") == "message_deleted").withColumn("v", slack_micros(F.col("ts")))
    doc = _doc(id=F.concat(F.lit("slack:"), "channel", F.lit("/"), "deleted_ts"), datasource=F.lit("slack"), container=F.concat(F.lit("slack:"), "channel"))
    deletes = gone.select(*_event("delete", doc, F.col("v"), F.floor(F.col("v") / 1000), "live"))
    return slack_messages(plain.unionByName(edits), people, channels, workspace).unionByName(deletes)


def slack_memberships(raw: DataFrame, people: DataFrame, channels: DataFrame) -> DataFrame:
    """(src, dst, present): joins and leaves of private channels by users that the directory knows."""
    e = raw.filter(F.col("type").isin("member_joined_channel", "member_left_channel"))
    e = e.join(people.filter(~blank(F.col("dir_id"))).select("user", "dir_id"), "user").join(channels.filter("is_private").select("channel"), "channel", "left_semi")
    return e.select(F.concat(F.lit("u:"), "dir_id").alias("src"), F.concat(F.lit("c:slack:"), "channel").alias("dst"), (F.col("type") == "member_joined_channel").alias("present"))


# Containers.

#: Teams that go to every container as one array; more go in several.
MOST_TEAMS = 2000


def container_edges(containers: DataFrame, known: DataFrame, teams: DataFrame) -> DataFrame:
    """(src, dst): the grants of containers (id, visibility) that aren't known (id) yet. public: everyone; members: none; empty: by the id's hash, 55 of 100 are public, others go to one to three teams (team, topic), those whose topic the id names first."""
    new = containers.join(known.select("id"), "id", "left_anti").dropDuplicates(["id"]).withColumn("h", fnv1a64("id"))
    auto = blank(F.col("visibility"))
    public = (F.col("visibility") == "public") | auto & (F.col("h") % 100 < 55)
    restricted = (F.col("visibility") == "restricted") | auto & (F.col("h") % 100 >= 55)
    dst = F.concat(F.lit("c:"), "id")
    out = new.filter(public).select(F.lit(EVERYONE).alias("src"), dst.alias("dst"))
    restricted_ = new.filter(restricted).select("id", (1 + F.col("h") % 3).cast("int").alias("most"))
    w = Window.partitionBy("id").orderBy(F.desc("fits"), seeded("id", "team"), "team")
    groups, best = max(1, -(-teams.count() // MOST_TEAMS)), None
    for g in range(groups):
        # A part of the teams, as an array of bounded length; of each part the best three of a container at most go on.
        listed = teams.select("team", "topic").filter(F.pmod(F.xxhash64("team"), F.lit(groups)) == g).collect()
        every = F.array(*[F.struct(F.lit(t.team).alias("team"), F.lit(t.topic).alias("topic")) for t in listed]) if listed else F.array().cast("array<struct<team:string,topic:string>>")
        part = restricted_.select("id", "most", F.explode(every).alias("t")).select("id", "most", "t.*")
        part = part.groupBy("id", "most", "team").agg(F.max(F.contains(F.lower("id"), F.lower("topic"))).alias("fits"))
        part = part.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= F.col("most")).drop("place")
        best = part if best is None else best.unionByName(part)
    topical = F.max("fits").over(Window.partitionBy("id"))
    r = best.withColumn("any", topical).withColumn("place", F.row_number().over(w))
    r = r.filter((F.col("place") <= F.col("most")) & (F.col("fits") | ~F.col("any")))
    return out.unionByName(r.select(F.concat(F.lit("g:"), "team").alias("src"), F.concat(F.lit("c:"), "id").alias("dst")))
