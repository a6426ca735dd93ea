"""The cursor protocol: nothing is lost at a cursor's own time, nothing comes twice, edits during a crawl come with the next one."""

import json

import pytest

from lodestar.sources import rest


class Repo:
    """A repository whose listing is sorted by the last update, in either direction."""

    def __init__(self):
        self.items, self.calls = {}, []

    def put(self, number, second):
        self.items[number] = {"number": number, "updated_at": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z"}

    def fetch(self, url, params, etag=""):
        self.calls.append(dict(params))
        if url.startswith("http://next/"):
            params = json.loads(url[len("http://next/") :].replace("'", '"'))
        own = sorted(self.items.values(), key=lambda x: (x["updated_at"], x["number"]), reverse=params["direction"] == "desc")
        own = [x for x in own if x["updated_at"] >= params.get("since", "")]
        page = int(params.get("page", 1))
        more = dict(params) | {"page": page + 1}
        link = {"Link": "<http://next/" + json.dumps(more).replace('"', "'") + '>; rel="next"'} if len(own) > page * 100 else {}
        return 200, link, own[(page - 1) * 100 : page * 100]


REPO = Repo()


def fetch(url, params, etag=""):
    return REPO.fetch(url, params, etag)


def reader(**more):
    REPO.items.clear()
    REPO.calls.clear()
    return rest._StreamReader({"kind": "github_issues", "base": "http://x", "units": "o/r", "transport": "tests.test_crawl:fetch"} | more)


def read(r, start, end):
    return sorted((json.loads(p)["number"], c) for part in r.partitions(start, end) for _, c, p in r.read(part))


def test_items_of_the_cursors_second():
    r = reader()
    for n in (1, 2, 3):
        REPO.put(n, n)
    first = r.latestOffset()
    assert [n for n, _ in read(r, r.initialOffset(), first)] == [1, 2, 3]
    # Two more, with the cursor's own second: they arrive, what was there doesn't come again.
    REPO.put(4, 3)
    REPO.put(5, 3)
    second = r.latestOffset()
    assert second["o/r"] == {"at": "2024-01-01T00:00:03Z", "marks": ["3", "4", "5"]}
    assert [n for n, _ in read(r, first, second)] == [4, 5]
    assert r.partitions(second, r.latestOffset()) == []


def test_edits_during_the_crawl():
    r = reader()
    for n in range(250):
        REPO.put(n, n)
    REPO.calls.clear()
    end = r.latestOffset()
    assert len(REPO.calls) == 1 and REPO.calls[0]["direction"] == "desc"  # the driver pages through nothing
    # Number 7 is edited, and one appears, before tasks read.
    REPO.put(7, 400)
    REPO.put(900, 249)
    got = [n for n, _ in read(r, r.initialOffset(), end)]
    assert got == [n for n in range(250) if n != 7]
    last = r.latestOffset()
    assert [n for n, _ in read(r, end, last)] == [7, 900]
    # The same offsets again give the same rows.
    assert [n for n, _ in read(r, end, last)] == [7, 900]


def test_many_of_one_second(monkeypatch):
    monkeypatch.setattr(rest, "MARKS", 20)
    r = reader()
    for n in range(130):
        REPO.put(n, 5)
    end = r.latestOffset()
    assert end["o/r"]["marks"] is None
    assert len(read(r, r.initialOffset(), end)) == 130
    REPO.put(500, 6)
    assert len(read(r, end, r.latestOffset())) == 131  # known ones come again, none is lost


def test_overlap_and_floor():
    r = reader(overlap_s="10", floor="2024-01-01T00:00:02Z")
    for n in range(30):
        REPO.put(n, n)
    end = r.latestOffset()
    assert [n for n, _ in read(r, r.initialOffset(), end)] == list(range(2, 30))
    REPO.put(100, 25)  # shown late, with an older time
    REPO.put(101, 31)
    got = [n for n, _ in read(r, end, r.latestOffset())]
    assert {100, 101} <= set(got) and min(got) == 19


def test_a_newest_item_that_goes_away():
    r = reader()
    REPO.put(1, 1)
    REPO.put(2, 2)
    end = r.latestOffset()
    del REPO.items[2]
    assert r.latestOffset() == end


def test_listings_once_a_generation(spark, tmp_path):
    rest.register(spark)
    options = {"kind": "slack_users", "base": "http://x", "units": "w", "transport": "tests.test_crawl:users", "every_s": "1000000000"}
    for _ in range(2):
        q = spark.readStream.format("crawl").options(**options).load().writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}"))
        q.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [json.loads(r.payload)["id"] for r in spark.read.parquet(f"{tmp_path}/out/*").orderBy("payload").collect()] == ["U1", "U2"]


def users(url, params):
    return 200, {}, {"ok": True, "members": [{"id": "U1"}, {"id": "U2"}]}


@pytest.mark.parametrize(("cursor", "zone", "want"), [("2024-01-01T10:00:05.000Z", "UTC", "2024-01-01 10:00"), ("2024-01-01T23:30:05.000Z", "Asia/Tokyo", "2024-01-02 08:30"), ("2024-01-01T10:00:05.000+0200", "UTC", "2024-01-01 08:00")])
def test_tracker_queries(cursor, zone, want):
    assert rest.project_search("K", cursor, zone) == f'project = "K" AND updated >= "{want}" ORDER BY updated ASC, key ASC'
    assert rest.project_search("K", "") == 'project = "K" ORDER BY updated ASC, key ASC'


def test_cursors_are_ordered_as_times():
    assert rest.written(rest.moment("2024-01-01T10:00:05.123+0200")) == "2024-01-01T08:00:05.123Z"
    assert rest.earlier("2024-01-01T00:00:05Z", 10) == "2023-12-31T23:59:55Z"
    assert rest.earlier("1700000005.000100", 5) == "1700000000.000100" and rest.earlier("", 5) == ""
