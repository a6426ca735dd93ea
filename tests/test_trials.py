"""Revocation measured on searches."""

from lodestar.operators import trials
from lodestar.operators.closure import Closure

TRIAL = "trial long, user string, doc_id long, query string, granted_ms long, revoked_ms long"
EDGE = "src string, dst string, present boolean, sent_ms long"


def docs(spark, rows):
    return spark.createDataFrame([(i, text, "", allowed, False, i == 9) for i, text, allowed in rows], "doc_id long, title string, body string, allowed array<string>, deleted boolean, quarantined boolean")


def run(spark, path, rows, asked, changes, kept=Closure):
    asked = spark.createDataFrame(asked, TRIAL)
    seen = trials.probe(docs(spark, rows), asked, spark.createDataFrame(changes, EDGE), kept(spark, f"file://{path}/c", buckets=2), [100, 200, 300])
    return {r.trial: tuple(r)[1:] for r in trials.latencies(asked, seen).collect()}


ROWS = [(1, "alpha one", ["c:a"]), (2, "beta two", ["c:b"]), (3, "gamma three", ["c:c"]), (4, "alpha four", ["c:c"]), (9, "hidden nine", ["c:a"])]
ASKED = [
    (1, "u:a", 1, "alpha", 50, 150), (2, "u:b", 2, "beta", 100, None), (3, "u:c", 3, "gamma alpha", 10, 250), (4, "u:d", 9, "hidden", 10, 150), (5, "u:e", 1, "", 10, 150), (6, "u:f", 1, "alpha", None, None), (7, "u:g", 2, "beta", 120, 130), (8, "u:h", 2, "beta", 150, 301),
]
CHANGES = [
    ("u:a", "g:1", True, 50), ("g:1", "c:a", True, 50), ("u:a", "g:1", False, 150), ("u:b", "c:b", True, 100), ("u:c", "c:c", True, 10), ("u:c", "c:c", False, 250), ("u:d", "g:2", True, 10), ("g:2", "c:a", True, 10),
    ("g:2", "c:a", False, 150), ("u:e", "c:a", True, 10), ("u:e", "c:a", False, 150), ("u:g", "c:b", True, 120), ("u:g", "c:b", False, 130), ("u:h", "c:b", True, 150), ("u:h", "c:b", False, 150), ("u:h", "c:b", True, 160), ("u:h", "c:b", False, 301),
]


def test_latencies(spark, tmp_path):
    """By trial: until shown, from the revoke until gone, timed out, others' documents. Trial 3 shares its container, 4 is hidden, 5 asks nothing, 6 is never granted, 7 is granted and revoked within a round, 8 revoked after the last one."""
    assert run(spark, tmp_path, ROWS, ASKED, CHANGES) == {
        1: (50, 50, False, 0), 2: (0, None, False, 0), 3: (90, 50, False, 2), 4: (None, None, False, 0), 5: (None, None, False, 0), 6: (None, None, False, 0), 7: (None, None, False, 0), 8: (50, None, True, 0),
    }


class Deaf(Closure):
    """Doesn't take over revokes."""

    def apply(self, changes, batch):
        return super().apply(changes.filter("present"), batch)


def test_a_revoke_that_is_lost_is_found(spark, tmp_path):
    got = run(spark, tmp_path, ROWS, ASKED[:3], CHANGES[:6], Deaf)
    assert got == {1: (50, None, True, 0), 2: (0, None, False, 0), 3: (90, None, True, 3)}


def test_no_trials(spark, tmp_path):
    assert run(spark, tmp_path, ROWS, [], []) == {}
