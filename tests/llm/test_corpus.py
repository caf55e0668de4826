import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import chat_format, decontaminate, fingerprint, jaccard_join, language_id, license_scan, mixing, quality, suffix_dedup, url_filter

ODD = "doc_id long, text string, lang string, source string, n_chars long, uid long, k long, words string, size long"


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, src, None, 7, 7, "w", 9) for i, t, lang, src in rows], ODD)


def edge_rows():
    r = random.Random(5)
    long = " ".join(r.choice("alpha beta gamma delta the of and to in".split()) for _ in range(6000))
    return [(1, None, "en", "a"), (2, "", None, None), (3, "short", "en", "a"), (4, long, "en", "b"), (4, long, "en", "b"), (5, long + " end", "en", None), (None, "no id here but words", "de", "b"), (7, "日本語 テキスト ✓", "fr", "c")]


ALL = {
    "suffix": lambda s, d: suffix_dedup.dedup(d), "license": lambda s, d: license_scan.scan(d), "fingerprint": lambda s, d: fingerprint.fingerprints(d), "jaccard": lambda s, d: jaccard_join.join(d),
    "mixing": lambda s, d: mixing.mix(d), "language": lambda s, d: language_id.identify(d), "quality": lambda s, d: quality.classify(d, s.createDataFrame([(3, 1, 0), (4, 0, 1), (7, None, 1)], "doc_id long, quality int, toxic int")),
}


@pytest.mark.parametrize("name", sorted(ALL))
def test_odd_rows_and_empty_tables(spark, name):
    rows = edge_rows()
    assert ALL[name](spark, docs(spark, rows)).count() == len(rows)
    assert ALL[name](spark, docs(spark, rows).limit(0)).count() == 0


def brute_dedup(rows, width):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - width + 1):
            if b[j : j + width] in seen:
                gone[j : j + width] = True
            seen.add(b[j : j + width])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_suffix_dedup_is_exact(spark):
    r = random.Random(1)
    base = ["".join(r.choice("ab é") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(50):
        t = "".join(b[r.randrange(300) :][: r.randrange(40, 400)] for b in r.sample(base, 3))
        rows.append((i, t + "x" * r.randrange(0, 350) * (i % 7 == 0) + (rows[i // 2][1] if i % 9 == 8 else "")))
    rows += [(100, None), (101, "z" * 500), (102, "z" * 99), (103, "z" * 100)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept_text").collect()
    assert sorted(map(tuple, got)) == brute_dedup(rows, 100)


def test_two_stage_sorting():
    r = random.Random(2)
    body = bytes(r.choice(b"aabbc") for _ in range(3000)) + b"a" * 200
    text = body + bytes(108) + b"\xff" * 8
    starts = np.sort(np.array(r.sample(range(3100), 1500)))
    word = suffix_dedup.all_words(text)
    order = suffix_dedup.suffix_array(text, word, starts, 100)
    assert sorted(order.tolist()) == starts.tolist()
    keys = [text[i : i + 100] for i in order]
    assert keys == sorted(keys)
    shared = suffix_dedup.shared_prefix(word, order, 100)
    want = [0] + [next((k for k in range(100) if a[k] != b[k]), 100) for a, b in zip(keys, keys[1:], strict=False)]
    assert shared.tolist() == want


def components_by_hand(rows, k, num, den):
    def shingles(t):
        w = [x for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return sorted((i, len(x), top(i)) for i, x in sets)


@pytest.mark.parametrize(("k", "num", "frequent"), [(3, 90, 16), (5, 80, 16), (3, 90, 2)])
def test_jaccard_join_is_exact(spark, monkeypatch, k, num, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    r = random.Random(3)
    known = [f"w{i}" for i in range(30)]
    bases = [[r.choice(known) for _ in range(r.choice([3, 10, 25, 60, 200]))] for _ in range(12)]
    rows = []
    for i in range(250):
        b = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4, 8])):
            b[r.randrange(len(b))] = r.choice(known)
        rows.append((i, " ".join(b)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A\tB"), (904, "w1")]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), k=k, num=num)
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == components_by_hand(rows, k, num, 100)


def test_row_numbers_of_many_partitions():
    from threadloom.llm import shared

    seen = [shared.row_ids(shared.first_block(p) + b, 3) for p in (0, 1, 2047, 2048, 5000, (1 << 23) - 1) for b in (0, 1, (1 << shared.BLOCK_BITS) - 1)]
    assert all(x.dtype == np.int64 and (x >= 0).all() for x in seen)
    assert len(np.unique(np.concatenate(seen))) == 3 * len(seen)
    with pytest.raises(ValueError, match="partitions"):
        shared.first_block(1 << 23)


def test_split_by_bucket_keeps_every_key():
    from threadloom.llm import shared

    keys = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    parts = shared.split_by_bucket(keys, 10**9)
    assert sorted(np.concatenate([at for _, at in parts]).tolist()) == list(range(5000))
    assert all((((keys[at] >> np.uint64(20)) % np.uint64(10**9)) == b).all() for b, at in parts)


def test_decontamination(spark):
    r = random.Random(4)
    known = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(known) for _ in range(r.choice([14, 30, 59])))) for i in range(12)]
    items.append((99, "too few words"))
    rows, want = [], set()
    for i in range(60):
        w = [r.choice(known) for _ in range(80)]
        if i % 3 == 0:
            item, text = items[i % 12]
            part = text.split()
            if i % 2:
                part[-1] = "changed"
            w[20:20] = [x.upper() + "," for x in part]
            want.add((i, item))
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, items[0][1])]
    want.add((502, 0))
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want
    assert all(x["similarity"] >= 0.8 and x["hamming"] <= decontaminate.RADIUS for x in got)
    assert {x["doc_id"]: x["start_word"] for x in got}[0] == 20


def test_repeated_rows_vote_once(spark):
    half = "general public", "permission is hereby granted free of charge to any person"
    rows = [(1, half[0]), (1, half[0]), (None, half[1]), (None, half[1]), (2, "the mit license"), (2, "the mit license")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6
    assert all((x["n_base"], x["base_labels"], x["labels"], x["score"]) == (0, "", "", 0.0) for x in got if x["doc_id"] != 2)
    assert [(x["n_base"], x["base_labels"], x["score"]) for x in got if x["doc_id"] == 2] == [(1, "mit", 1.0)] * 2


def best_windows_by_hand(docs, items, similar=0.8):
    """{(doc, item): (similarity, start)} over all starts, partial windows at either end too."""
    words = lambda t: re.findall("[0-9a-z]+", t.lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for d, t in docs:
        of = grams(words(t))
        for i, x in items:
            want = Counter(g := grams(words(x)))
            for s in range(1 - len(g), len(of)):
                have = Counter(of[max(s, 0) : max(s + len(g), 0)])
                common = sum((have & want).values())
                alike = common / (sum(have.values()) + len(g) - common)
                if alike >= similar and ((d, i) not in out or (-alike, max(s, 0)) < out[d, i]):
                    out[d, i] = (-alike, max(s, 0))
    return out


def test_decontamination_tries_every_start(spark):
    r = random.Random(21)
    known = [f"word{i}" for i in range(300)]
    pick = lambda n: [r.choice(known) for _ in range(n)]
    items = [(i, pick(n)) for i, n in enumerate([50, 59, 120, 30, 80, 120])] + [(6, pick(4) * 12)]
    rows = []
    for i, w in items:
        h = len(w) // 2
        for moved in (w[h:] + w[:h], w[: h // 2] + w[h:] + w[h // 2 : h], w[h:] + pick(1) + w[:h], w, w[: -len(w) // 7]):
            rows.append((len(rows), " ".join(pick(r.randrange(40)) + moved + pick(r.randrange(40)))))
            rows.append((len(rows), " ".join(moved)))
    # A long text in which the item stands twice, once whole.
    rows.append((len(rows), " ".join(items[1][1][30:] + items[1][1][:30] + pick(60) + items[1][1])))
    items = [(i, " ".join(w)) for i, w in items]
    want = best_windows_by_hand(rows, items)
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): (-x["similarity"], x["start_word"]) for x in got} == want
    assert {(2 * j, i) for i, j in ((0, 0), (1, 5), (2, 10))} <= set(want)


def test_multi_index_covers_the_radius(spark):
    r = random.Random(6)
    rows = []
    for i in range(200):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 21):
            b ^= 1 << bit
        rows.append((i, *(x - (1 << 64) if x >> 63 else x for x in (a, b))))
    df = spark.createDataFrame(rows, "i long, a long, b long").select(F.arrays_overlap(decontaminate.index_blocks("a"), decontaminate.index_blocks("b")).alias("meet"))
    assert df.where("meet").count() == 200


def test_fingerprints(spark):
    r = random.Random(7)
    rows = [(i * 3, "".join(r.choice("abcdé ") for _ in range(r.randrange(0, 400)))) for i in range(40)] + [(1007, same := "same text " * 20), (1008, same), (1009, None)]
    for parts in (1, 4):
        got = {x["doc_id"]: x for x in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), parts=parts).collect()}
        ids = sorted(dict(rows), reverse=True)
        for i, a in enumerate(ids):
            text, after = dict(rows)[a] or "", dict(rows)[ids[(i + 1) % len(ids)]] or ""
            third = len(text) // 3
            edited = text[: len(text) - third] + after[:third]
            assert got[a]["n_chars"] == len(text) and got[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()

            def fresh(t):
                seen, phrases = set(), []
                fingerprint.parse(t, seen, phrases)
                return fingerprint._text_of(fingerprint.signature(fingerprint.hashed(phrases)))

            assert got[a]["fingerprint"] == fresh(text) and got[a]["edited_fingerprint"] == fresh(edited)
        assert got[1008]["fingerprint"] == got[1007]["fingerprint"] and got[1008]["near_next"] == 1.0


def test_license_scan(spark):
    rows = [(1, "Released under the MIT-License. mit license\nApache License"), (2, "GNU General Public, License v3; the Apache; licence"), (3, "words only"), (4, None)]
    got = {x["doc_id"]: x for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (9, 3, 3, 7, "apache,mit")
    assert got[1]["labels"] == "apache,mit,mit-notice"
    assert (got[2]["n_base"], got[2]["base_labels"]) == (1, "gpl") and got[3]["first_word"] is None and got[4]["n_words"] == 0
    cut = "permission is hereby granted free of charge to any person who is obtaining a copy of this software and associated documentation files"
    assert license_scan.scan(spark.createDataFrame([(1, cut)], "doc_id long, text string")).first()["labels"] == "mit-grant"


def test_mixing_meets_its_targets(spark):
    r = random.Random(8)
    rows = [(i, " ".join("w" * r.randrange(1, 60)), None, r.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    df = docs(spark, rows)
    got = mixing.mix(df, seed=3).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(3), seed=3).collect()), key=str)
    sizes = {}
    for x in got:
        sizes.setdefault(x["source"], [0, x["target"], x["source_size"]])[0] += x["taken"]
        assert x["taken"] <= 2 * x["size"]
    names, weights = ["a", "b", "c", None], [5, 2, 1, 5]
    open_, target, left = set(names), {}, 1.5 * sum(v[2] for v in sizes.values())
    while True:
        unit = left / sum(w for n, w in zip(names, weights, strict=True) if n in open_)
        over = [n for n, w in zip(names, weights, strict=True) if n in open_ and unit * w > 2 * sizes[n][2]]
        if not over:
            break
        for n in over:
            target[n] = 2 * sizes[n][2]
            left -= target[n]
            open_.remove(n)
    for n, w in zip(names, weights, strict=True):
        assert sizes[n][1] == pytest.approx(target.get(n, unit * w)) and abs(sizes[n][0] - sizes[n][1]) <= 2


def test_exchanges_mend_what_is_owed():
    r = np.random.default_rng(11)
    size = np.r_[r.integers(1, 300, 40), 5000, 7000].astype(float)
    taken = (r.random(42) < 0.5).astype(float)
    owed = float((size * 0.5).sum())
    out = mixing.repaired(taken, size, owed)
    assert set(out) <= {0.0, 1.0} and abs(float((out * size).sum()) - owed) <= min(20, abs(float((taken * size).sum()) - owed))
    assert mixing.repaired(np.zeros(0), np.zeros(0), 0.0).tolist() == []


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 500, 500).astype(float)
    p = np.full(500, 0.37)
    out = mixing.flight(p, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())


def test_language_is_learned(spark):
    r = random.Random(9)
    known = {"aa": "the of and thing other ander thon".split(), "bb": "der die und ung heit keit schen".split(), "cc": "que los cion mente ador ella".split()}
    rows = [(i, " ".join(r.choice(known[lang]) for _ in range(80)), lang, "s") for i in range(200) for lang in [r.choice(list(known))]] + [(900, "12 34 !", "aa", "s"), (901, None, "bb", "s")]
    got = {x["doc_id"]: x for x in language_id.identify(docs(spark, rows)).collect()}
    truth = {i: lang for i, _, lang, _ in rows[:-2]}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in truth.items() if got[i]["held_out"]]) > 0.95
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[901]["score"] == 0 and got[900]["rejected"]


def test_url_rules_and_trees(spark):
    urls = ["http://A.Example.com/en/70", "http://x.org/es/", "http://q.net/de/1?x#y", "http://b.example.net/de/8", "http://com/en/", "http://notcom/en/", None, "nothing", "https://shop.example.org#f"]
    got = {x["page_id"]: x for x in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(9)] == ["example.com/en/7", "org/es/", "net/de/", "example.net/de/8", "com/en/", None, None, None, None]
    assert [got[i]["verdict"] for i in range(5)] == ["allow", "block", "allow", "block", "block"]
    assert (got[0]["host"], got[2]["path"], got[6]["host"], got[7]["path"], got[8]["host"]) == ("a.example.com", "/de/1", "", "", "shop.example.org")
    x = np.random.default_rng(1).random((400, 12))
    y = (x[:, 2] > 0.5).astype(float)
    model = url_filter.Trees.fit(x, y)
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], url_filter.FEATURES)
    p = np.array([r[0] for r in df.select(model.column([F.col(c) for c in url_filter.FEATURES])).collect()])
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.98


def test_quality_shrinks_sparse_sites(spark):
    scored = spark.createDataFrame([("big", "big/en", 0.9 if i % 10 else 0.1) for i in range(400)] + [("mid", "mid/en", 0.2)] * 100 + [("tiny", "tiny/en", 0.0)], "host string, path string, p double")
    got = {x["host"]: x for x in quality.posteriors(scored, "p").collect()}
    assert got["mid"]["path_p"] == pytest.approx(0.2, abs=0.05) and got["tiny"]["path_p"] > 0.1
    r = random.Random(10)
    rows = [(i, " ".join(r.choice("good plain words of many kinds here".split()) for _ in range(40)) + (" vile slur" if i % 5 == 0 else ""), "en", f"s{i % 7}") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["toxic"] >= 0.5 for x in quality.classify(docs(spark, rows), labels).collect()}
    assert all(got[i] == (i % 5 == 0) for i in range(400))


def test_tool_calls_are_linked(spark):
    tools = json.dumps({"tools": [{"name": "find", "parameters": {"properties": {"q": {"type": "string"}, "n": {"type": "integer"}}, "required": ["q"]}}]})
    call = lambda i, a: {"id": i, "name": "find", "arguments": a}
    rows = [
        (1, 0, "system", tools), (1, 1, "user", "hi"), (1, 3, "assistant", json.dumps({"tool_calls": [call("a", {"q": "x", "n": 2}), call("b", {"n": "2"})], "content": "z"})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": [1, {"b": 1, "a": 2}]})),
        (1, 4, "tool", json.dumps({"tool_call_id": "gone"})), (2, None, None, None), (2, 1, "user", '{"tool_calls": broken'), (None, 0, "user", "x"),
    ]
    got = {(x["conv_id"], x["turn"]): x for x in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    calls = got[1, 3]
    assert (calls["call_ids"], calls["n_calls"], calls["n_linked"], calls["n_invalid"]) == ("a,b", 2, 1, 1)
    assert got[1, 2]["answers_turn"] == 3 and got[1, 2]["position"] == calls["position"] + 1
    assert got[1, 4]["answers_turn"] is None and got[1, 4]["n_linked"] == 0
    assert '"content":[1,{"a":2,"b":1}]' in got[1, 2]["json"]
    assert got[1, 1]["json"] == '{"content":"hi","role":"user"}' and got[2, 1]["kind"] == "content"
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
