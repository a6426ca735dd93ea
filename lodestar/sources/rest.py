"""Crawled sources as Python data sources for batch and streaming reads.

A reader lists its units (repositories, projects, issues, channels, workspaces), one Spark partition each, and pages through a unit from its cursor, which is inclusive. A stream's offset holds, for each unit, the time of its newest item and the keys of the items of that very time (its marks): the driver asks for the newest items alone, tasks page through what lies between two offsets. So items that share the cursor's second arrive, whenever they come, and none twice; what is edited while it is being read has a newer time then and comes with the next offset. With an overlap what is a little older is read again, for sources that show items late; the fold drops what it knows. Listings without times are read as a whole, once a generation. Only a transport, `fetch(url, params) -> (status, headers, json)`, touches the network; it is named by module and function in the options, so executors import their own. A transport that also takes the keyword `etag` gets that of the last answer when a stream asks whether there is anything new, and may answer 304.
"""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "unit string, cursor string, payload string"


def transport(name: str):
    """The function that 'module:function' names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def get(fetch, url: str, params: dict, tries: int = 5, sleep=None, etag: str = "") -> tuple[int, dict, object]:
    """One request; waits and repeats when told to slow down."""
    for _ in range(tries):
        status, headers, body = fetch(url, params, etag=etag) if etag else fetch(url, params)
        if status != 429:
            return status, headers, body
        (sleep or time.sleep)(float(headers.get("Retry-After", 1)))
    raise IOError(f"{url}: still told to slow down after {tries} tries")


def repository_pages(fetch, base: str, repo: str, what: str, since: str, etags: dict[str, str] | None = None) -> Iterator[tuple[str, dict]]:
    """(updated_at, item) of a repository's issues or comments from since on, oldest first. Where the listing refuses deep pages it starts anew from the last time seen. etags: those of first pages by place, kept up to date; an unchanged listing has nothing."""
    seen: set = set()
    place = f"{base}/{repo}/{what}/{since}"
    while True:
        url, params, last = f"{base}/repos/{repo}/{what}", {"state": "all", "sort": "updated", "direction": "asc", "per_page": 100} | ({"since": since} if since else {}), since
        first = True
        while url:
            known = (etags or {}).get(place, "") if first and place else ""
            status, headers, body = get(fetch, url, params, etag=known)
            if etags is not None and first and place and status == 200 and headers.get("ETag"):
                if len(etags) >= 10_000:
                    etags.clear()
                etags[place] = headers["ETag"]
            first = False
            if status == 422 and last != since:
                break
            if status == 304:
                return
            if status != 200:
                raise IOError(f"{url}: status {status}")
            for item in body:
                last = item["updated_at"]
                if (item["id"] if "id" in item else item["number"], last) not in seen:
                    seen.add((item["id"] if "id" in item else item["number"], last))
                    yield last, item
            m = re.search(r'<([^>]+)>;[^,]*rel="next"', headers.get("Link", ""))
            url, params = (m[1] if m else None), {}
        else:
            return
        since, place = last, ""


def moment(text: str) -> datetime | None:
    """An ISO time, the zone with or without colon; None if it isn't one."""
    try:
        t = datetime.fromisoformat(text)
    except ValueError:
        return None
    return t if t.tzinfo else t.replace(tzinfo=UTC)


def written(t: datetime) -> str:
    """A time as all cursors are written: UTC, to the millisecond, so that their order is that of time."""
    return t.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"


def project_search(project: str, since: str, zone: str = "UTC", newest: bool = False) -> str:
    """A tracker's query for a project's issues from the minute of a cursor on, in the account's zone."""
    t = moment(since)
    minute = "" if t is None else f' AND updated >= "{t.astimezone(ZoneInfo(zone)):%Y-%m-%d %H:%M}"'
    way = "DESC" if newest else "ASC"
    return f'project = "{project}"{minute} ORDER BY updated {way}, key {way}'


def project_pages(fetch, base: str, project: str, since: str, page: int = 50, zone: str = "UTC") -> Iterator[tuple[str, dict]]:
    """(updated, issue) of a project from the minute of since on. Each page starts at the last minute seen, so edits during the crawl shift nothing; offsets count only within one minute."""
    seen, start, query = set(), 0, project_search(project, since, zone)
    while True:
        status, _, body = get(fetch, f"{base}/rest/api/2/search", {"jql": query, "startAt": start, "maxResults": page, "fields": "*all"})
        if status != 200:
            raise IOError(f"{base}: status {status}")
        issues = body["issues"]
        for issue in issues:
            mark = (issue["key"], issue["fields"]["updated"])
            if mark not in seen:
                seen.add(mark)
                yield written(moment(issue["fields"]["updated"])), issue
        if len(issues) < page:
            return
        again = project_search(project, written(moment(issues[-1]["fields"]["updated"])), zone)
        start, query = (start + page, query) if again == query else (0, again)


def issue_comments(fetch, base: str, key: str, page: int = 100) -> Iterator[dict]:
    start = 0
    while True:
        _, _, body = get(fetch, f"{base}/rest/api/2/issue/{key}/comment", {"startAt": start, "maxResults": page})
        yield from body["comments"]
        start += len(body["comments"])
        if start >= body["total"] or not body["comments"]:
            return


def channel_pages(fetch, base: str, channel: str, oldest: str) -> Iterator[tuple[str, dict]]:
    """(ts, message) of a channel after oldest."""
    cursor = ""
    while True:
        status, _, body = get(fetch, f"{base}/conversations.history", {"channel": channel, "oldest": oldest, "limit": 200} | ({"cursor": cursor} if cursor else {}))
        if status != 200 or not body.get("ok", True):
            raise IOError(f"{channel}: {body.get('error') if isinstance(body, dict) else status}")
        for m in body["messages"]:
            yield m["ts"], m
        cursor = (body.get("response_metadata") or {}).get("next_cursor") or ""
        if not cursor:
            return


def workspace_pages(fetch, base: str, method: str, items: str, params: dict) -> Iterator[tuple[str, dict]]:
    """("", item) of a workspace's listing (users, channels, a channel's members), page by page."""
    cursor = ""
    while True:
        status, _, body = get(fetch, f"{base}/{method}", params | {"limit": 200} | ({"cursor": cursor} if cursor else {}))
        if status != 200 or not body.get("ok", True):
            raise IOError(f"{method}: {body.get('error') if isinstance(body, dict) else status}")
        for x in body[items]:
            yield "", x if isinstance(x, dict) else {"id": x} | params
        cursor = (body.get("response_metadata") or {}).get("next_cursor") or ""
        if not cursor:
            return


def comment_pages(fetch, base: str, key: str, since: str) -> Iterator[tuple[str, dict]]:
    """(updated, comment with its issue's key) of an issue: all its pages, whatever since is, as comments can vanish."""
    for c in issue_comments(fetch, base, key):
        yield c["updated"], c | {"key": key}


def newest_of_repository(fetch, base: str, repo: str, what: str, etag: str = "") -> Iterator[tuple[str, str, str]]:
    """(updated_at, key, ETag of the listing), the newest first; nothing if it is as it was when it had this ETag."""
    url, params, first, tag = f"{base}/repos/{repo}/{what}", {"state": "all", "sort": "updated", "direction": "desc", "per_page": 100}, True, ""
    while url:
        status, headers, body = get(fetch, url, params, etag=etag if first else "")
        if status == 304:
            return
        if status != 200:
            raise IOError(f"{url}: status {status}")
        tag, first = tag or headers.get("ETag", ""), False
        for item in body:
            yield item["updated_at"], str(item["id"] if "id" in item else item["number"]), tag
        m = re.search(r'<([^>]+)>;[^,]*rel="next"', headers.get("Link", ""))
        url, params = (m[1] if m else None), {}


def newest_of_project(fetch, base: str, project: str, zone: str = "UTC", page: int = 50) -> Iterator[tuple[str, str, str]]:
    start = 0
    while True:
        status, _, body = get(fetch, f"{base}/rest/api/2/search", {"jql": project_search(project, "", zone, newest=True), "startAt": start, "maxResults": page, "fields": "updated"})
        if status != 200:
            raise IOError(f"{base}: status {status}")
        for issue in body["issues"]:
            yield written(moment(issue["fields"]["updated"])), issue["key"], ""
        if len(body["issues"]) < page:
            return
        start += page


def newest_of_channel(fetch, base: str, channel: str) -> Iterator[tuple[str, str, str]]:
    """The newest message: a time is a message's key."""
    status, _, body = get(fetch, f"{base}/conversations.history", {"channel": channel, "limit": 1})
    if status != 200 or not body.get("ok", True):
        raise IOError(f"{channel}: {body.get('error') if isinstance(body, dict) else status}")
    for m in body["messages"][:1]:
        yield m["ts"], m["ts"], ""


#: Kinds with times: the newest items of a unit, the newest first.
NEWEST = {
    "github_issues": lambda fetch, base, unit, zone, etag: newest_of_repository(fetch, base, unit, "issues", etag),
    "github_comments": lambda fetch, base, unit, zone, etag: newest_of_repository(fetch, base, unit, "issues/comments", etag),
    "jira": lambda fetch, base, unit, zone, etag: newest_of_project(fetch, base, unit, zone),
    "slack": lambda fetch, base, unit, zone, etag: newest_of_channel(fetch, base, unit),
}
#: Keys of one time that an offset names at most; beyond it items of that time may come again.
MARKS = 1000


PAGES = {
    "github_issues": lambda fetch, base, unit, since, etags=None: repository_pages(fetch, base, unit, "issues", since, etags),
    "github_comments": lambda fetch, base, unit, since, etags=None: repository_pages(fetch, base, unit, "issues/comments", since, etags),
    "jira": lambda fetch, base, unit, since, etags=None, zone="UTC": project_pages(fetch, base, unit, since, zone=zone),
    "jira_comments": lambda fetch, base, unit, since, etags=None: comment_pages(fetch, base, unit, since),
    "slack": lambda fetch, base, unit, since, etags=None: channel_pages(fetch, base, unit, since),
    "slack_users": lambda fetch, base, unit, since, etags=None: workspace_pages(fetch, base, "users.list", "members", {}),
    "slack_channels": lambda fetch, base, unit, since, etags=None: workspace_pages(fetch, base, "conversations.list", "channels", {"types": "public_channel,private_channel"}),
    "slack_members": lambda fetch, base, unit, since, etags=None: workspace_pages(fetch, base, "conversations.members", "members", {"channel": unit}),
}


def key_of(kind: str, item: dict) -> str:
    if kind == "jira":
        return item["key"]
    return item["ts"] if kind == "slack" else str(item["id"] if "id" in item else item["number"])


def earlier(cursor: str, seconds: float) -> str:
    """A cursor so many seconds before another one."""
    if not seconds or not cursor:
        return cursor
    if (t := moment(cursor)) is not None:
        t -= timedelta(seconds=seconds)
        return written(t) if "." in cursor else t.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return f"{max(0.0, float(cursor) - seconds):.6f}"


class _Unit(InputPartition):
    """What a unit has from a cursor on, up to another one if that is given; start, end: the offsets that these are of."""

    def __init__(self, unit: str, since: str, start: dict | None = None, end: dict | None = None):
        self.unit, self.since, self.start, self.end = unit, since, start, end


def _rows(options: dict, unit: str, since: str) -> Iterator[tuple[str, str, str, str]]:
    """(unit, cursor, payload, key)."""
    fetch, kind = transport(options["transport"]), options["kind"]
    more = {"zone": options.get("zone", "UTC")} if kind == "jira" else {}
    for cursor, item in PAGES[kind](fetch, options["base"].rstrip("/"), unit, since, **more):
        yield unit, cursor, json.dumps(item), key_of(kind, item) if kind in NEWEST else ""


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        since, floor = json.loads(self.options.get("cursors", "{}")), self.options.get("floor", "")
        return [_Unit(u, max(since.get(u, ""), floor)) for u in self.options["units"].split(",") if u]

    def read(self, partition):
        for row in _rows(self.options, partition.unit, partition.since):
            yield row[:3]


class _StreamReader(DataSourceStreamReader):
    """The driver asks each unit for its newest items, no more; the rows between two offsets are read by tasks, one for each unit that has any."""

    def __init__(self, options: dict):
        self.options, self.etags, self.last = options, {}, {}
        self.units = [u for u in options["units"].split(",") if u]
        self.listing = options["kind"] not in NEWEST

    def initialOffset(self):
        cursors = json.loads(self.options.get("cursors", "{}"))
        return {u: {"at": cursors.get(u, ""), "marks": []} for u in self.units}

    def _newest(self, unit: str) -> dict | None:
        """The offset of a unit by now; None if nothing is said to have changed, or there is nothing."""
        fetch = transport(self.options["transport"])
        at, marks = None, []
        for cursor, key, tag in NEWEST[self.options["kind"]](fetch, self.options["base"].rstrip("/"), unit, self.options.get("zone", "UTC"), self.etags.get(unit, "")):
            if tag:
                self.etags[unit] = tag
            if at is not None and cursor < at:
                break
            at = cursor
            marks.append(key)
            if len(marks) > MARKS:
                break
        return None if at is None else {"at": at, "marks": sorted(set(marks)) if len(marks) <= MARKS else None}

    def latestOffset(self):
        if self.listing:
            generation = f"{int(time.time() // float(self.options.get('every_s', 3600))):012d}"
            return {u: {"at": generation, "marks": []} for u in self.units}
        if self.units:
            with ThreadPoolExecutor(min(16, len(self.units))) as pool:
                for unit, now in zip(self.units, pool.map(self._newest, self.units), strict=True):
                    # A newest item that went away doesn't take the cursor back.
                    if now is not None and now["at"] >= self.last.get(unit, {"at": ""})["at"]:
                        self.last[unit] = now
        return self.initialOffset() | self.last

    def partitions(self, start: dict, end: dict):
        none, out = {"at": "", "marks": []}, []
        overlap, floor = float(self.options.get("overlap_s", 0)), self.options.get("floor", "")
        for u, e in end.items():
            s = start.get(u, none)
            # A listing that was read in this generation, or an offset that went back, has nothing new.
            if e != s and e["at"] >= s["at"]:
                out.append(_Unit(u, "" if self.listing else max(earlier(s["at"], overlap), floor), s, e))
        return out

    def read(self, partition):
        start, end = partition.start, partition.end
        for unit, cursor, payload, key in _rows(self.options, partition.unit, partition.since):
            if self.listing:
                yield unit, end["at"], payload
                continue
            before = cursor == start["at"] and key in (start["marks"] or ())
            after = cursor > end["at"] or cursor == end["at"] and end["marks"] is not None and key not in end["marks"]
            if cursor >= partition.since and not before and not after:
                yield unit, cursor, payload


class Crawl(DataSource):
    """Options: kind (one of PAGES), base, units (comma-separated), transport (module:function), cursors (JSON by unit: where to begin), floor (nothing older is read), overlap_s (seconds that are read again), zone (of the tracker's account), every_s (seconds of a listing's generation)."""

    @classmethod
    def name(cls):
        return "crawl"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))

    def streamReader(self, schema):
        return _StreamReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(Crawl)
