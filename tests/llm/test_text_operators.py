"""Operators on texts: contracts, edges, brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import bpe, chat, common, decontaminate, pii, quality, secrets, shards, toxicity

EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "plain words here"), (4, "plain words here"), (None, "no id")]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("spans", F.lit(1))


def secret_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]


def personal_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    return out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()


def noise(seed, n, pieces):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40)))) for i in range(n)]


def test_secrets_base(spark):
    rows = noise(1, 400, ["password", "Token", ": ", "=", "'", '"', "api_key", "apikey", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", " ", "é", "ſecret", "x"]) + EDGES
    got = secrets.find_secrets(table(spark, rows)).select("doc_id", "base_sha256", "n_assign", "n_access", "n_hex").collect()
    want = []
    for d, t in rows:
        s = secret_base(t or "")
        want.append((d, digest(s, secrets.KINDS), *[sum(x[1] == k for x in s) for k in range(3)]))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a password: hunter22 b", 22), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(df).collect()}
    assert got == {1: ("a [SECRET] b", 12), 2: ("clean", 5), 3: (None, None)}


def test_battery_tells_random_from_words():
    rng = random.Random(2)
    b = secrets.Battery(np.array([10.0 if chr(i).islower() else 1.0 for i in range(256)]), np.array([[5, 1, 1, 1], [1, 900, 1, 1], [1, 1, 5, 1], [1, 1, 1, 5]], float))
    random_p = [b.p("".join(rng.choice(secrets.ALPHABETS["base62"]) for _ in range(40))) for _ in range(50)]
    assert np.median(random_p) < 1e-6 and b.p("internationalisation_of_software") > 0.01 and b.p("1234567890123456") == 1.0


def test_personal_base(spark):
    rows = noise(3, 400, ["a.b", "@", "x.org", "1.2.3.4", "999", ".", "4111 1111 1111 1111", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "+1 ", "(555) ", "0100", "-", " ", "é"]) + EDGES + [(90, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1")]
    got = pii.find_personal_data(table(spark, rows)).select("doc_id", "base_sha256", "n_email", "n_ip", "n_card", "n_phone").collect()
    want = []
    for d, t in rows:
        s = personal_base(t or "")
        want.append((d, digest(s, pii.KINDS), *[sum(x[1] == k for x in s) for k in range(4)]))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_bootstrap_finds_unseen_identifiers(spark):
    rows = [(i, f"please call me at +1 555 010{i:04d} today") for i in range(30)] + [(100 + i, f"please call me at 555.{i}47.0{i}12 today") for i in range(5)]
    got = {r.doc_id: r.n_found for r in pii.find_personal_data(table(spark, rows)).collect()}
    assert all(got[100 + i] == 1 for i in range(5)) and all(got[i] == 0 for i in range(30))


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_file())
    t.no_truncation()
    t.no_padding()
    rows = noise(4, 300, ["hello", "World", "'s", "'RE", " ", "\n", "\t", "123", "é", "ΑΣ", "İ", "中文", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "!?", " ", "\x1c", "͸", "ᴫ", "a" * 300]) + EDGES
    got = sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in bpe.encode(table(spark, rows)).collect()), key=repr)
    want = []
    for d, text in rows:
        e = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(e), " ".join(map(str, e)), t.decode(e, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    again = bpe.encode(table(spark, rows), form="packed").select("n_tokens", "ids").collect()  # the same file is handed out once
    assert all(len(r.ids) == 2 * r.n_tokens for r in again)


def test_lexicon_holds_its_words(tmp_path):
    words = ["a", "ab", "abc", "tab", "stab", "é"]
    bpe.compile_lexicon(words, [[i] * (i + 1) for i in range(len(words))], str(tmp_path / "x"))
    lex = bpe.Lexicon(str(tmp_path / "x"))
    n = lex.numbers([w.encode() for w in [*words, "b", "abcd", "sta"]])
    assert [lex.ids(i) for i in n[:6]] == [[i] * (i + 1) for i in range(6)] and list(n[6:]) == [-1, -1, -1]


def brute_leaks(docs, items, threshold=0.8):
    from collections import Counter

    out = {}
    split = lambda t: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())
    for i, it in items:
        w = split(it)
        if not w:
            continue
        k = min(5, len(w))
        a = Counter(tuple(w[x : x + k]) for x in range(len(w) - k + 1))
        for d, t in docs:
            v = split(t)
            best = 0.0
            for s in range(max(1, len(v) - len(w) + 1)):
                win = v[s : s + len(w)]
                kk = min(k, len(win))
                b = Counter(tuple(win[x : x + kk]) for x in range(len(win) - kk + 1)) if win else Counter()
                union = sum((a | b).values())
                best = max(best, sum((a & b).values()) / union if union else 0)
            if best >= threshold:
                out[d, i] = round(best, 9)
    return out


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: "w%d" % rng.randrange(300)
    items = [(i, " ".join(word() for _ in range(rng.randrange(30, 60)))) for i in range(12)] + [(20, "one two"), (21, None), (22, "")]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rng.randrange(5, 120))]
        if d % 3 == 0:
            part = items[rng.randrange(12)][1].split()
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = word()
            text[10:10] = part
        docs.append((d, " ".join(text)))
    docs += [(100, "so one, TWO!"), (101, None), (102, "")]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(docs, items)
    exact = {k for k, v in want.items() if v >= 0.95}
    assert exact <= set(got) and set(got) <= set(want) and all(want[k] == v for k, v in got.items())
    assert len(got) >= 0.9 * len(want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(table(spark, docs), none).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be [INST] kind"), (1, 1, "user", "</s>\\ hi"), (1, 2, "assistant", None), (2, 0, "assistant", "first"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, None, None, "x<|end|>"), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("system\nbe [INST] kind\nuser\n</s>\\ hi\nassistant\n\n") and got[1].valid and got[1].loss_chars == 0
    assert not got[2].valid and got[2].loss_sha256 == sha("first") and not got[3].valid and got[3].n_turns == 2 and not got[4].valid and got[None].valid
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 1000, 4097])
def test_permutation(n):
    x = shards.permute(np.arange(n), n)
    assert sorted(x.tolist()) == list(range(n)) and shards.permute(x, n, back=True).tolist() == list(range(n))


def test_shards(spark, tmp_path, monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(shards, "SHARD", 64)
    rng = random.Random(7)
    rows = [(i, " ".join(f"word{rng.randrange(1000)}" for _ in range(rng.randrange(0, 900)))) for i in range(60)] + [(None, "no id"), (5, None)]
    uri = f"file://{tmp_path}/shards"
    n = shards.materialise(table(spark, rows), uri)
    want = sorted((shards._NULL if d is None else d, s, tuple(ids[s * 256 : s * 256 + 256].tolist())) for d, t in rows for ids in [shards.token_ids(t or "", P.path("byte_bpe_50k.tiktoken"))] for s in range(-(-len(ids) // 256)))
    records = np.concatenate(list(shards.read_slots(uri, 0, n)))
    assert sorted((int(r["doc_id"]), int(r["seq_no"]), tuple(r["ids"][: r["n_tokens"]].tolist())) for r in records) == want
    assert [int(r["seq_no"]) for r in np.concatenate(list(shards.read_slots(uri, 70, 90)))] == [int(x) for x in records["seq_no"][70:90]]
    again = f"file://{tmp_path}/again"
    assert shards.materialise(table(spark, rows), again) == n and all((tmp_path / "again" / f.name).read_bytes() == f.read_bytes() for f in (tmp_path / "shards").glob("*.bin"))
    assert shards.materialise(table(spark, rows).limit(0), f"file://{tmp_path}/none") == 0
    monkeypatch.undo()
    whole = f"file://{tmp_path}/whole"
    assert shards.read_back(spark, whole, shards.materialise(table(spark, rows), whole)).count() == n


def test_classifiers_on_edges(spark):
    df, none = table(spark, EDGES), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    q = quality.score(df.select("doc_id", "text"), quality.train(df, none)).collect()
    assert len(q) == 6 and {r.score for r in q} == {0.5}
    channel = toxicity.Channel(toxicity.letter_counts(df))
    assert len(toxicity.score(df, channel, toxicity.train(df, none, channel)).collect()) == 6


def test_deobfuscation():
    text = "stupid people are stupid and idiots say stupid idiot things " * 50
    counts = np.zeros(toxicity.SIGNS**3, np.int64)
    s = np.concatenate([[0, 0], toxicity._SIGN[np.frombuffer(text.encode(), np.uint8)], [0]])
    np.add.at(counts, (s[:-2] * 28 + s[1:-1]) * 28 + s[2:], 1)
    c = toxicity.Channel(counts)
    for hidden in ("5tup1d", "s.t.u.p.i.d", "stuuupid", "1d10t"):
        assert toxicity.disguised(f"you {hidden} one"), hidden
        assert {"stupid", "idiot"} & set(c.restore(toxicity.disguised(f"you {hidden} one")[0].strip())), hidden


def test_held_out_accuracy(spark):
    """Both classifiers on their held-out labels of sf0.1 texts: far better than chance."""
    from lodestar.llm.quality import op10_quality
    from lodestar.llm.toxicity import op9_toxicity

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    for op, label in ((op9_toxicity, "toxic"), (op10_quality, "quality")):
        rows = op(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").select("score", F.col(label).alias("y")).filter("y is not null").collect()
        y, p = np.array([r.y for r in rows]), np.array([r.score for r in rows])
        rank = p.argsort().argsort()
        auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
        assert auc > 0.9, (label, auc, len(rows))


def channel_of(spark, *texts):
    return toxicity.Channel(toxicity.letter_counts(table(spark, list(enumerate(texts)))))


def test_long_and_spaced_disguises(spark):
    c = channel_of(spark, "you are such a stupid idiot and you are a stupid person, such idiots are stupid; " * 50, "der blöde dödel ist blöd und der dödel ist blöde; " * 50)
    words = lambda text: {w for d in toxicity.disguised(text) for w in c.restore(d)}
    spell = lambda text, by: by.join(text.replace(" ", ""))
    assert {"you", "stupid", "idiot"} <= words(spell("you are such a stupid idiot", " "))
    assert {"you", "idiot"} <= words("y o u i d i o t")
    for hidden in (spell("stupid", "  "), "stup****d", "s--t--u--p--i--d", "st" + "u" * 60 + "pid", "5" + "t" * 45 + "up1d"):
        assert "stupid" in words(f"so {hidden} one"), hidden
    for hidden in (spell("blöde", "."), "blöööde", "bl.öde", "8löde"):
        assert "blöde" in words(f"so {hidden} da"), hidden
    long = words(spell("you are such a stupid idiot " * 400, " "))
    assert {"stupid", "idiot", "such"} <= long


def test_rows_with_disguises_reach_the_channel(spark):
    import pyarrow as pa

    c = channel_of(spark, "der blöde dödel ist blöd " * 50)
    hidden, plain = (sum(len(f) for _, _, f, _ in toxicity.restored(pa.array([t]), c)) for t in ("bl" + "ö" * 9 + "de", "bl" + "ö" * 2 + "de"))
    assert hidden > plain


def test_secrets_within_tokens(spark):
    rng = random.Random(5)
    key = lambda n, more="": "".join(rng.choice(secrets.ALPHABETS["base62"] + more) for _ in range(n))
    rows, values = [(1000 + i, "plain words of a text that go on and on " * 20) for i in range(50)], {}
    for i in range(40):
        before, value = [("GH_PAT=", key(40)), ("get ?sig=", key(42, "+/") + "=="), ("X-Amz-Signature=", key(44)), ("a/b/c/my-own_", key(20) + "+" + key(20) + "/" + key(20) + "+/" + key(10))][i % 4]
        rows.append((i, f"run {before}{value} now"))
        values[i] = (4 + len(before), 4 + len(before) + len(value), value)
    df = table(spark, rows)
    got = {r.doc_id: r.spans for r in secrets.find_secrets(df).collect()}
    found = sum(f"random:{a}:{b}" in got[i].split(",") for i, (a, b, _) in values.items())
    assert found >= 36, (found, got)
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert sum(v not in clean[i] for i, (_, _, v) in values.items()) >= 36 and clean[0].startswith("run GH_PAT=")
    assert all("random" not in got[1000 + i] for i in range(50))


def test_tokens_have_no_overlaps_and_keep_whole_ones():
    t = "NAME=abcdefghij0123456789 1234567890123456 abcdefghijklmnop== aaaaaaaaaaaaaaaa/b-cccccccccccccccc_d=== x"
    got = [t[a:b] for a, b in secrets.tokens(t)]
    assert got == ["abcdefghij0123456789", "abcdefghijklmnop==", "aaaaaaaaaaaaaaaa", "b-cccccccccccccccc_d==="]


def test_bootstrap_finds_identifiers_in_groups_and_without_digits(spark):
    rows = [(i, f"please call me at +1 555 010{i:04d} today") for i in range(30)]
    hidden = ["DE89 3704 0044 0532 0130 00", "123 45 6789", "4111 1111 1111 111", "555 01 23 45", "(030) 123-4567", "jo at mail dot example"]
    rows += [(100 + i, f"please call me at {x} today") for i, x in enumerate(hidden)]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(table(spark, rows)).collect()}
    assert [got[100 + i] for i in range(len(hidden))] == [f"found:18:{18 + len(x)}" for x in hidden]


def test_long_instances_with_one_beginning_differ(spark):
    rows = [(i, f"x {'a' * 200}{1000 + i} y") for i in range(3)]
    slots = [r.slots[0].instance for r in pii.occurrences(table(spark, rows)).collect()]
    assert len(set(slots)) == 3


def test_partitioning_changes_nothing(spark):
    """Counts end with their texts, so the same rows in 1 and in 7 partitions give the same results."""
    rng = random.Random(8)
    key = lambda n: "".join(rng.choice(secrets.ALPHABETS["base62"]) for _ in range(n))
    rows = [(i, f"so {key(24)} a st{'u' * (i % 5 + 1)}pid 5tup1d thing{i} été")[: 2] for i in range(60)] + EDGES
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, seven = df.coalesce(1), df.repartition(7)
    for a, b in zip(secrets.ordinary_text(one), secrets.ordinary_text(seven), strict=True):
        assert (a == b).all()
    a, b = (dict(zip(*(x.tolist() for x in toxicity.letter_counts(d)), strict=True)) for d in (one, seven))
    assert a == b
    for find in (secrets.find_secrets, pii.find_personal_data):
        assert sorted(map(repr, find(one).collect())) == sorted(map(repr, find(seven).collect()))


def test_segments_change_no_counts(spark, monkeypatch):
    from lodestar.llm import common

    df = spark.createDataFrame([(i, f"word{i} and Ünd Token=abc{i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    want = secrets.ordinary_text(df), sorted(zip(*toxicity.letter_counts(df), strict=True))
    monkeypatch.setattr(common, "SEGMENT", 37)
    got = secrets.ordinary_text(df), sorted(zip(*toxicity.letter_counts(df), strict=True))
    assert all((a == b).all() for a, b in zip(want[0], got[0], strict=True)) and want[1] == got[1]


def test_long_texts_in_seconds():
    """Texts of megabytes with ten thousands of spans, also without any space."""
    import time

    from lodestar.llm import spans

    began = time.perf_counter()
    many = " ".join(f"user{i}@host{i}.example ref{i:08d}" for i in range(50_000))
    for text in (many, many.replace(" ", ";")):
        found = pii.base_spans(text)
        cover = spans.Cover(found)
        others = [(m.start(), m.end()) for m in pii.TOKEN.finditer(text) if not cover.meets(*m.span())]
        assert len(found) == 50_000 and len(others) >= 49_000
        assert len(pii._contexts(text, [(a, b) for a, _, b in found] + others)) == len(found) + len(others)
    assert len(list(secrets.tokens("x=" + "Ab3" * 1_000_000))) == 1
    assert time.perf_counter() - began < 30


def test_cover():
    from lodestar.llm import spans

    rng = random.Random(9)
    for _ in range(200):
        some = [(a, 0, a + rng.randrange(1, 8)) for a in (rng.randrange(60) for _ in range(rng.randrange(6)))]
        cover = spans.Cover(some)
        for a in range(70):
            for n in (1, 4):
                assert cover.meets(a, a + n) == any(a < y and x < a + n for x, _, y in some)


def test_every_letter_is_the_library_s():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_file())
    t.no_truncation()
    t.no_padding()
    encoder = bpe.Encoder(bpe.vocabulary_file(), None)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    texts = ["x".join(points[i : i + 64]) for i in range(0, len(points), 64)]
    marks = [c for c in points if __import__("unicodedata").combining(c)]
    texts += ["".join(f"a{c}̣́ A̧{c} " for c in marks[i : i + 50]) for i in range(0, len(marks), 50)]
    n, ids, names = encoder.encode_batch(texts)
    for text, k, i in zip(texts, n.to_pylist(), ids.to_pylist(), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert i == " ".join(map(str, want)) and k == len(want), [hex(ord(c)) for c in text if c != "x"]


def test_channel_against_all_paths():
    """Viterbi against enumeration: every path of short lattices, the cheapest price of each text, the words of the three cheapest."""
    import math

    text = "stupid people are stupid and idiots say stupid idiot things to all " * 30
    counts = np.zeros(toxicity.SIGNS**3, np.int64)
    s = np.concatenate([[0, 0], toxicity._SIGN[np.frombuffer(text.encode(), np.uint8)], [0]])
    np.add.at(counts, (s[:-2] * 28 + s[1:-1]) * 28 + s[2:], 1)
    c = toxicity.Channel(counts)
    for span in ("5tup", "1d1ot", "s.t.u", "a11", "st**d", "too", "s  t"):
        paths = {"": 0.0}
        for sign in span:
            new: dict = {}
            for letters, price in paths.items():
                for x, more in c.arcs(sign, letters[-1:]):
                    a, b = ([0, 0] + [c._sign_of(y) for y in letters])[-2:]
                    total = price + more + (c.cost(a, b, c._sign_of(x)) if x else 0.0)
                    to = letters + x
                    new[to] = min(total, new.get(to, math.inf))
            paths = new
        ends = []
        for letters, price in paths.items():
            a, b = ([0, 0] + [c._sign_of(y) for y in letters])[-2:]
            if letters:
                ends.append((price + (c.cost(a, b, 0) if b else 0.0), letters))
        ends.sort()
        want = [w for _, letters in ends[:3] for w in letters.split()]
        assert set(c.restore(span)) == set(want), (span, c.restore(span), ends[:4])


def test_trees_against_plain_traversal_and_all_splits():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)).round(2)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = quality.fit(x, y, trees=12, depth=3)

    def walk(node, row):
        while model.left[node] != node:
            node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
        return model.value[node]

    plain = [1 / (1 + np.exp(-(model.start + sum(walk(r, row) for r in model.roots)))) for row in x]
    assert np.allclose(model.score(x), plain) and ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95
    # One tree of one split: the best of all thresholds of all features.
    one = quality.fit(x, y, trees=1, depth=1)
    p = 1 / (1 + np.exp(-one.start))
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = -1.0
    for j in range(5):
        for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])):
            low = x[:, j] <= t
            if min(low.sum(), (~low).sum()) >= quality.LEAST:
                best = max(best, sum(g[m].sum() ** 2 / (h[m].sum() + quality.PENALTY) for m in (low, ~low)))
    low = x[:, one.feature[0]] <= one.threshold[0]
    assert np.isclose(best, sum(g[m].sum() ** 2 / (h[m].sum() + quality.PENALTY) for m in (low, ~low)))


def test_false_discoveries_against_the_plain_procedure(spark):
    rng = random.Random(11)
    rows = [(i, [(0, 20, rng.randrange(len(secrets.LENGTHS)), rng.choice([rng.randrange(4), rng.randrange(40, 400)])) for _ in range(rng.randrange(4))]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, tested array<struct<start:int,end:int,class:int,bin:int>>")
    got = secrets.limits(df)
    for c in range(len(secrets.LENGTHS)):
        bins = sorted((b for _, ts in rows for *_, k, b in ts if k == c), reverse=True)
        p = [10 ** (-b * secrets.BIN) for b in bins]
        found = [i for i in range(len(p)) if p[i] <= secrets.FDR * (i + 1) / len(p)]
        assert {b for b in bins if b >= got[c]} == (set(bins[: max(found) + 1]) if found else set()), c


def test_bootstrap_against_plain_rounds(spark):
    rng = random.Random(12)
    seeds = [f"seed{i}" for i in range(40)]
    others = [f"other{i}" for i in range(60)]
    words = [f"w{i}" for i in range(8)]
    slots = [{"start": 0, "end": 1, "seed": x.startswith("seed"), "instance": x, "patterns": [f"{rng.choice(words)} {rng.choice(words[:3])} _", f"{rng.choice(words[:3])} _ {rng.choice(words)}"]} for x in seeds + others for _ in range(3)]
    df = spark.createDataFrame([(i, slots[i : i + 5]) for i in range(0, len(slots), 5)], "row long, slots array<struct<start:int,end:int,seed:boolean,instance:string,patterns:array<string>>>")
    edges = {(p, s["instance"]) for s in slots for p in s["patterns"]}
    by = {p for p in {p for p, _ in edges} if sum(x.startswith("seed") for q, x in edges if q == p) >= pii.SUPPORT}
    edges = {e for e in edges if e[0] in by}
    score = {x: float(x.startswith("seed")) for _, x in edges}
    for _ in range(pii.ROUNDS):
        pattern = {p: sum(score[x] for q, x in edges if q == p) / (sum(q == p for q, _ in edges) + pii.PRIOR) for p in by}
        score = {x: 1.0 if x.startswith("seed") else 1 - np.prod([1 - pattern[p] for p, z in edges if z == x]) for x in score}
    want = {x: s for x, s in score.items() if x.startswith("other") and s >= pii.CONFIDENCE and sum(z == x for _, z in edges) >= 2}
    got = {r.instance: r.score for r in pii.bootstrap(df).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


NONE = "doc_id long, text string"


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], NONE), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert secrets.find_secrets(none).count() == 0 and secrets.redact(none).count() == 0
    assert pii.find_personal_data(none).count() == 0
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.clean(none, items).count() == 0
    assert bpe.encode(none).count() == 0
    channel = toxicity.Channel(toxicity.letter_counts(none))
    assert toxicity.score(none, channel, toxicity.train(none, labels, channel)).count() == 0
    assert quality.score(none, quality.train(none, labels)).count() == 0
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_very_long_texts(spark, tmp_path):
    """A text of some megabytes beside short ones, through every operator on texts; what is found at its end counts."""
    words = [f"word{i % 997}" for i in range(300_000)]
    item = " ".join(f"item{i}" for i in range(40))
    long = " ".join(words) + f" {item} password: hunter2222 jo@example.org s.t.u.p.i.d"
    df = spark.createDataFrame([(1, long), (2, "short text"), (3, None)], NONE)
    size = len(long)
    r = {x.doc_id: x for x in secrets.find_secrets(df).collect()}
    assert r[1].n_assign == 1 and "hunter2222" not in {x.doc_id: x.text for x in secrets.redact(df).collect()}[1]
    r = {x.doc_id: x for x in pii.find_personal_data(df).collect()}
    assert r[1].n_email == 1 and r[1].spans.startswith(f"email:{size - len('jo@example.org s.t.u.p.i.d')}:")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(x.doc_id, x.item_id, x.similarity) for x in decontaminate.contaminated(df, items).collect()] == [(1, 7, 1.0)]
    assert {x.doc_id for x in decontaminate.clean(df, items).collect()} == {2, 3}
    encoded = {x.doc_id: x for x in bpe.encode(df).collect()}
    assert encoded[1].n_tokens > 300_000 and encoded[1].ids.count(" ") == encoded[1].n_tokens - 1 and encoded[3].n_tokens == 0
    channel = toxicity.Channel(toxicity.letter_counts(df))
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(df, channel, toxicity.train(df, labels, channel)).count() == 3
    assert quality.score(df, quality.train(df, labels)).count() == 3
    assert shards.materialise(df, f"file://{tmp_path}/s") > 1000
    talk = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(talk)).first().loss_chars == size


def test_clean_judges_rows_by_their_texts(spark):
    item = " ".join(f"item{i}" for i in range(30))
    df = spark.createDataFrame([(None, f"a {item} b", 1), (5, f"a {item} b", 2), (5, "another text", 3), (6, None, 4)], "doc_id long, text string, item_id long")
    kept = decontaminate.clean(df, spark.createDataFrame([(1, item), (2, None)], "item_id long, text string"))
    assert kept.columns == df.columns and sorted(r.item_id for r in kept.collect()) == [3, 4]


def test_columns_that_clash(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words of a text here"), (2, None)], NONE)
    for name in ("part", "place", "seq_no", "ids", "n_tokens", "slot", "shard", "predicted", "score", "x", "y", "lists", "sig", "text2"):
        df = df.withColumn(name, F.lit("z"))
    assert shards.materialise(df, f"file://{tmp_path}/s") == 1
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("t"))
    scored = quality.score(df, quality.train(df, labels))
    assert {f.name: f.dataType.simpleString() for f in scored.schema.fields}["score"] == "double" and scored.count() == 2
    assert quality.kept(df, quality.train(df, labels)).columns == df.columns


def test_common_words_point_at_nothing(spark):
    """Six seeds follow "of the", which 200 other words follow as well; each seed follows "call me"."""
    rows = [(i, f"of the +1 555 010{i:04d} call me +1 555 010{i:04d} today") for i in range(6)] + [(100 + i, f"of the thing{i} call") for i in range(200)]
    bits, _ = pii.pointing(table(spark, rows))
    word = lambda w: next(common.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])))[2]
    known = lambda a, b: bool(pii._known(bits, pii._pair(word(a), word(b)))[0])
    assert known("call", "me") and not known("of", "the")
    # With a tenth of the occurrences they point.
    bits, _ = pii.pointing(table(spark, rows[: 6 + 54]))
    assert known("of", "the")
    bits, _ = pii.pointing(table(spark, rows[: 6 + 55]))
    assert not known("of", "the")


def test_two_words_before_against_plain_words():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "B", "é", "x:", "^", "_"]) for _ in range(rng.randint(0, 6))) + rng.choice(["", " ", "\n", "\xa0"]) for _ in range(300)] + [None, "", " "]
    word = lambda w: next(common.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())])))[2]
    got = {}
    for row, first, pairs in pii._two_before(*common.text_buffers(pa.array(texts))):
        got |= {row + r: pairs[first[r] : first[r + 1]].tolist() for r in range(len(first) - 1)}
    for i, t in enumerate(texts):
        w = ["^", "^"] + [m[0].translate(pii.LOWER) for m in pii.WORD.finditer(t or "")]
        assert got[i] == [int(pii._pair(word(a), word(b))[0]) for a, b in zip(w[:-2], w[1:-1], strict=True)]


def test_planted_identifiers_of_five_kinds(spark):
    """Identifiers that no base pattern matches, in texts of the given table, with the contexts of seeds: recall, and precision of all that is found."""
    rng = random.Random(21)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kinds = {
        "please call me on {} after": (lambda: f"+44 20 {digits(4)} {digits(4)}", lambda: f"(020) {digits(4)} {digits(4)}"),
        "my mail is {} or": (lambda: f"user{digits(4)}@mail.example", lambda: f"user{digits(4)} at mail dot example"),
        "logged in from {} at": (lambda: f"10.{digits(2)}.{digits(2)}.7", lambda: f"fe80::{digits(4)}:{digits(4)}:a1"),
        "paid by card {} on": (lambda: "4111 1111 1111 1111", lambda: f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} 00"),
        "text us at {} any": (lambda: f"+1 555 {digits(3)} {digits(4)}", lambda: f"555/{digits(7)}"),
    }
    rows, where = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()], {}
    free = iter(rng.sample([i for i, (_, t) in enumerate(rows) if t], 5 * 50))
    cards = iter(c for n in range(10_000) if pii.luhn(c := f"411111111111{n:04d}"))
    for context, (seed, hidden) in kinds.items():
        for n in range(50):
            i = next(free)
            d, t = rows[i]
            x = (next(cards) if "card" in context else seed()) if n < 40 else hidden()
            lead = t + " " + context.split("{")[0]
            rows[i] = d, lead + x + context.split("}")[1]
            if n >= 40:
                where[d] = (len(lead), len(lead) + len(x))
    got = {r.doc_id: {tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("found")} for r in pii.find_personal_data(table(spark, rows)).collect()}
    right = sum(where[d] in got[d] for d in where)
    recall, precision = right / len(where), right / max(1, sum(map(len, got.values())))
    print(f"planted identifiers: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9
