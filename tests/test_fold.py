"""The fold against a sequential one, and its contracts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import fold
from lodestar.schemas import ITEM
from lodestar.session import cut

HASH = lambda t, b: hashlib.sha256(t.encode() + b"\0" + b.encode()).hexdigest()[:32]


def sequential(events, state):
    """One event after the other, as the rules say."""
    out = dict(state)
    for e in sorted(events, key=lambda e: e["off"]):
        s = out.get(e["id"])
        if e["op"] == "poison":
            s = dict(s or {"version": 0, "title": None, "url": None, "hash": None, "deleted": False, "poison": 0, "needs": False})
            s["poison"] = max(s["poison"], e["at_ms"])
        elif s is not None and e["version"] <= s["version"]:
            continue
        else:
            s = dict(s or {"title": None, "url": None, "hash": None, "poison": 0, "needs": False})
            if e["op"] == "delete":
                s |= {"title": "", "hash": "", "deleted": True, "needs": False}
            else:
                h = HASH(e["title"], e["body"])
                s |= {"needs": s["needs"] or h != (s["hash"] or ""), "title": e["title"], "url": e["url"], "hash": h, "deleted": False}
            s["version"] = e["version"]
            if e["src_ts_ms"] > s["poison"]:
                s["poison"] = 0
        out[e["id"]] = s
    return out


def rows_of(df):
    return {r.id: {"version": r.version, "title": r.title, "url": r.url, "hash": r.content_hash, "deleted": r.deleted, "poison": r.quarantined_at_ms, "needs": r.needs_embed} for r in df.collect()}


def frame(spark, events):
    kinds = "id string, off long, op string, version long, src_ts_ms long, at_ms long, title string, body string, url string"
    return spark.createDataFrame([tuple(e.get(c) for c in ("id", "off", "op", "version", "src_ts_ms", "at_ms", "title", "body", "url")) for e in events], kinds)


def made(rng, docs=60, most=8):
    events = []
    for d in range(docs):
        for _ in range(rng.randint(1, most)):
            v = rng.randint(1, 6)
            events.append({"id": f"d{d}", "op": rng.choices(["upsert", "delete", "poison"], [6, 2, 2])[0], "version": v, "src_ts_ms": rng.randint(1, 50), "at_ms": rng.randint(1, 50), "title": rng.choice("ab"), "body": rng.choice("xy"), "url": f"u{rng.randint(0, 9)}"})
    rng.shuffle(events)
    for i, e in enumerate(events):
        e["off"] = i
    return events


@pytest.mark.parametrize("seed", range(4))
def test_fold_is_sequential(spark, seed):
    events = made(random.Random(seed))
    want = {k: v for k, v in sequential(events, {}).items()}
    assert rows_of(fold.fold(frame(spark, events))) == want


def test_batches_end_in_the_same_state(spark):
    events = made(random.Random(9))
    state, want = None, {}
    for lo in range(0, len(events), 40):
        part = events[lo : lo + 40]
        want = sequential(part, want)
        state = cut(fold.merged(state, fold.fold(frame(spark, part), state)), "state")
    assert rows_of(state) == want


def test_replay_changes_nothing(spark):
    events = [e for e in made(random.Random(3)) if e["op"] != "poison"]
    state = fold.fold(frame(spark, events)).cache()
    again = fold.fold(frame(spark, [e | {"off": e["off"] + 1000} for e in events]), state)
    assert again.count() == 0


def test_delete_then_late_upsert(spark):
    e = [{"id": "a", "off": 0, "op": "upsert", "version": 1, "src_ts_ms": 1, "title": "t", "body": "b", "url": "u"}, {"id": "a", "off": 1, "op": "delete", "version": 3, "src_ts_ms": 3}, {"id": "a", "off": 2, "op": "upsert", "version": 2, "src_ts_ms": 2, "title": "z", "body": "z", "url": "z"}]
    r = fold.fold(frame(spark, e)).first()
    assert (r.deleted, r.version, r.title, r.url, r.content_hash, r.allowed, r.labels) == (True, 3, "", "u", "", [], [])


def test_quarantine_of_unknown_document(spark):
    r = fold.fold(frame(spark, [{"id": "a", "off": 0, "op": "poison", "at_ms": 5}])).first()
    assert (r.version, r.quarantined, r.deleted, r.needs_embed, r.allowed) == (0, True, False, False, [])


def test_metadata_change_keeps_vector(spark):
    e = [{"id": "a", "off": 0, "op": "upsert", "version": 1, "src_ts_ms": 1, "title": "t", "body": "b", "url": "u"}]
    state = fold.fold(frame(spark, e))
    v = spark.createDataFrame([("a", HASH("t", "b"), [1.0, 2.0])], "id string, content_hash string, embedding array<float>")
    state = fold.write_vectors(state, v).cache()
    assert not state.first().needs_embed
    r = fold.merged(state, fold.fold(frame(spark, [e[0] | {"off": 1, "version": 2, "url": "new"}]), state)).first()
    assert (r.url, r.needs_embed, r.embedding) == ("new", False, [1.0, 2.0])
    r = fold.merged(state, fold.fold(frame(spark, [e[0] | {"off": 1, "version": 2, "body": "new"}]), state)).first()
    assert (r.needs_embed, r.embedding) == (True, [1.0, 2.0])


def test_vector_of_an_old_text_is_dropped(spark):
    state = fold.fold(frame(spark, [{"id": "a", "off": 0, "op": "upsert", "version": 1, "src_ts_ms": 1, "title": "t", "body": "b", "url": "u"}]))
    v = spark.createDataFrame([("a", "old", [1.0])], "id string, content_hash string, embedding array<float>")
    assert fold.write_vectors(state, v).first().embedding is None


def test_empty_batch(spark):
    none = spark.createDataFrame([], ITEM)
    assert fold.fold(none).count() == 0 and fold.discards(fold.gate(none)).count() == 0
    assert fold.without_container(fold.fold(none), "x").filter(F.lit(True)).count() == 0
