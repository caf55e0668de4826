"""The corpus operators against plain versions of what they compute, on small random tables."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_corpus import best_windows_by_hand, brute_dedup, components_by_hand
from threadloom.llm import chat_format, decontaminate, fingerprint, language_id, license_scan, quality, shared, url_filter


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_license_places(spark):
    r = random.Random(41)
    pieces = ["MIT license", "apache  License", "General-Public", "license", "Licens", "mit", "public", "the", "a\u212aLicense", "İ", "é9", "\n", "apache\nlicense,mit license", "released under the"]
    rows = [(i, " ".join(r.choice(pieces) for _ in range(r.randrange(0, 25)))) for i in range(150)] + [(900, None), (901, ""), (902, "...")]
    got = {x["doc_id"]: x for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = words_of(t)
        at = [(j, label) for phrase, label in license_scan.BASE.items() for j in range(len(w)) if w[j : j + len(phrase.split())] == phrase.split()]
        x, starts = got[i], [j for j, _ in at]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"]) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert x["base_labels"] == ",".join(sorted({label for _, label in at}))
        assert set(x["base_labels"].split(",")) <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1 and (x["score"] == 1) >= bool(at)


@pytest.mark.parametrize("label", sorted(license_scan.TEMPLATES))
def test_every_template_is_found(label):
    assert len(license_scan.TEMPLATES[label].split()) > 1 and words_of(license_scan.TEMPLATES[label]) == license_scan.TEMPLATES[label].split()


def test_templates_with_changes(spark):
    r = random.Random(42)
    rows = []
    for i, (_, text) in enumerate(sorted(license_scan.TEMPLATES.items())):
        w = text.split()
        rows += [(3 * i, " ".join(["x", *w, "y"])), (3 * i + 1, " ".join([*w[: len(w) // 2], "added", *w[len(w) // 2 :]]) if len(w) > 11 else text), (3 * i + 2, " ".join(r.sample(w, len(w))))]
    got = {x["doc_id"]: x["labels"].split(",") for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(sorted(license_scan.TEMPLATES)):
        assert label in got[3 * i] and label in got[3 * i + 1]


def test_templates_with_one_edit(spark):
    """A word missing, added or replaced anywhere: found where 0.8 of the 2-grams are left."""
    rows, want = [], {}
    for label, text in sorted(license_scan.TEMPLATES.items()):
        w = text.split()
        for i in range(1, len(w) - 1):
            for kind, new, lost in (("missing", w[:i] + w[i + 1 :], 2), ("two missing", w[:i] + w[i + 2 :], 3 if i + 2 < len(w) else 2), ("added", w[:i] + ["zz"] + w[i:], 1), ("two added", w[:i] + ["zz", "yy"] + w[i:], 1), ("replaced", w[:i] + ["zz"] + w[i + 1 :], 2)):
                want[len(rows)] = (label, kind, 1 - lost / (len(w) - 1))
                rows.append((len(rows), " ".join(["a", *new, "b"])))
    got = {x["doc_id"]: (x["labels"].split(","), x["score"]) for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, kind, share) in want.items():
        if share >= 0.8 + 1e-9:
            assert label in got[i][0] and got[i][1] >= share - 1e-9, (label, kind, rows[i])


def test_fingerprints_by_hand(spark):
    r = random.Random(43)
    rows = [(i, "".join(r.choice("abcé") for _ in range(r.randrange(0, 300)))) for i in range(30)]

    def phrases(t):
        seen, i = set(), 0
        while i < len(t):
            n = next((n for n in range(1, len(t) - i + 1) if t[i : i + n] not in seen), None)
            if n is None:
                break
            seen.add(t[i : i + n])
            i += n
        return seen

    def alike(x, y):
        x, y = phrases(x), phrases(y)
        return len(x & y) / len(x | y) if x | y else 1.0

    got = {x["doc_id"]: x for x in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), parts=3).collect()}
    texts, apart = dict(rows), []
    for i, t in rows:
        after = texts[(i - 1) % 30]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        seen, found = set(), []
        fingerprint.parse(t, seen, found)
        assert set(found) == phrases(t) and len(found) == len(set(found))
        for name, true in (("near_edited", alike(t, edited)), ("near_next", alike(t, after))):
            apart.append(got[i][name] - true)
            assert 0 <= got[i][name] <= 1
    # 64 slots: a standard error of at most 1/16 for each.
    assert abs(np.mean(apart)) < 0.05 and np.max(np.abs(apart)) < 0.3


def test_a_document_is_not_its_own_evidence(spark):
    r = random.Random(44)
    rows = [(f"h{i % 3}", f"h{i % 3}/{i % 2}", r.random() if i % 11 else None) for i in range(60)] + [("one", "one/a", 0.99), (None, "/", 0.2)]
    df = spark.createDataFrame(rows, "host string, path string, p double")
    site = quality.posteriors(df, "p").withColumnsRenamed({"host": "_h", "path": "_p"})
    by_host, by_path = quality.left_out("p")
    got = df.join(site, F.col("host").eqNullSafe(F.col("_h")) & (F.col("path") == F.col("_p"))).select("host", "path", "p", by_host.alias("a"), by_path.alias("b"), "host_m", "path_m", "global_p").collect()
    assert len(got) == len(rows)
    for x in got:
        def mean(j, prior, m):
            own = [p for row in rows for h, q, p in [row] if (h, q)[j] == (x["host"], x["path"])[j] and p is not None]  # noqa: B023
            k, n = sum(own) - (x["p"] or 0.0), len(own) - (x["p"] is not None)  # noqa: B023
            return (k + m * prior) / (n + m)

        a = mean(0, x["global_p"], x["host_m"])
        assert x["a"] == pytest.approx(a) and x["b"] == pytest.approx(mean(1, a, x["path_m"]))
    alone = next(x for x in got if x["host"] == "one")
    assert alone["a"] == pytest.approx(alone["global_p"]) and alone["b"] == pytest.approx(alone["global_p"])


def strength_by_hand(groups, parent, estimated):
    """One-way random effects by moments: within over between."""
    groups = [np.array(g) for g in groups if len(g)]
    n, k = sum(map(len, groups)), len(groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (n - k)
    apart = sum(len(g) * (g.mean() - q) ** 2 for g, q in zip(groups, parent, strict=True))
    between = (apart - (k - estimated) * within) / (n - estimated * sum(len(g) ** 2 for g in groups) / n)
    return min(max(within / between, 0.01), 1e6) if between > 0 else 1e6


@pytest.mark.parametrize("effect", [0.0, 0.15, 0.4])
def test_strengths_by_hand(spark, effect):
    """Sites that differ are believed, sites that don't aren't; both levels and the posteriors from them, by plain sums."""
    r = random.Random(int(effect * 100))
    rows = [(f"h{h}", f"h{h}/{q}", min(1.0, max(0.0, r.gauss(0.5 + effect * (h % 3 - 1), 0.2)))) for h in range(9) for q in range(3) for _ in range(r.randrange(1, 30))]
    rows += [("h0", "h0/none", None)]
    df = spark.createDataFrame(rows, "host string, path string, p double")
    got = {x["path"]: x for x in quality.posteriors(df, "p").collect()}
    of = lambda j, name: [x[2] for x in rows if x[j] == name and x[2] is not None]
    hosts = sorted({x[0] for x in rows})
    overall = (sum(x[2] or 0 for x in rows) + 1) / (len(rows) - 1 + 2)
    host_m = strength_by_hand([of(0, h) for h in hosts], [overall] * len(hosts), 1)
    host_p = {h: (sum(of(0, h)) + host_m * overall) / (len(of(0, h)) + host_m) for h in hosts}
    paths = sorted({x[1] for x in rows if x[2] is not None})
    path_m = strength_by_hand([of(1, q) for q in paths], [host_p[q.split("/")[0]] for q in paths], 0)
    for q in paths:
        x = got[q]
        assert (x["host_m"], x["path_m"], x["host_p"]) == (pytest.approx(host_m), pytest.approx(path_m), pytest.approx(host_p[x["host"]]))
        assert x["path_p"] == pytest.approx((sum(of(1, q)) + path_m * x["host_p"]) / (len(of(1, q)) + path_m))
    assert got["h0/none"]["path_p"] == pytest.approx(host_p["h0"])
    assert (host_m > 50) == (effect == 0) and (effect < 0.4 or host_m < 3)


def test_sites_move_documents(spark):
    """Texts say nothing and sources do: a document's answer follows its site's others."""
    r = random.Random(12)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(30)) + (" fine" * 3 if r.random() < (0.9 if i % 4 else 0.1) else " poor" * 3), f"s{i % 4}", "en") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(" fine" in t), 0) for i, t, _, _ in rows if i % 2], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    bad, good = ([x["quality_path"] for x in got if (x["host"] == "s0") == k] for k in (True, False))
    assert max(bad) < 0.35 and min(good) > 0.6 and all((x["quality"] < x["quality_doc"]) == (x["host"] == "s0") for x in got if 0.001 < x["quality_doc"] < 0.999)


def test_windows_as_native_and_by_hand(spark):
    r = random.Random(45)
    known = [f"w{i}" for i in range(120)]
    items = [(i, [r.choice(known) for _ in range(n)]) for i, n in enumerate([15, 22, 22, 40])]
    rows = []
    for _ in range(25):
        w = [r.choice(known) for _ in range(r.randrange(0, 30))]
        part = list(r.choice(items)[1])
        cut = r.randrange(len(part))
        part = r.choice([part, part[cut:] + part[:cut], [x if r.random() > 0.04 else "new" for x in part], part[: len(part) - len(part) // 6]])
        rows.append((len(rows), " ".join(w + part + w[::-1])))
    rows += [(100, None), (101, ""), (102, "w1 w2")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got, full = (sorted(map(tuple, run(docs, bench).drop("hamming").collect())) for run in (decontaminate.matches, decontaminate.native))
    want = best_windows_by_hand([(i, t or "") for i, t in rows], [(i, " ".join(w)) for i, w in items])
    assert got == full and len(want) > 10
    found = {(d, i) for d, i, *_ in got}
    assert found <= set(want) and len(found) >= 0.9 * len(want)


def test_native_windows_across_stretches(spark, monkeypatch):
    """Long texts in several rows of running sums, items whose counts need wider lanes, more items of a size than a group holds."""
    r = random.Random(48)
    known = [f"w{i}" for i in range(90)]
    items = [(i, " ".join(r.choice(known) for _ in range(n))) for i, n in enumerate([15] * 10 + [20, 75])]
    texts = [" ".join(" ".join([r.choice(known) for _ in range(r.randrange(60))] + [r.choice(items)[1]]) for _ in range(12)) for _ in range(4)] + [items[11][1], None, "", "w1"]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "STRETCH", 64)
    got, full = (sorted(map(tuple, run(docs, bench).drop("hamming").collect())) for run in (decontaminate.matches, decontaminate.native))
    assert got == full and len(got) > 20
    assert not decontaminate.native(docs, bench.limit(0)).collect() and not decontaminate.native(docs.limit(0), bench).collect()


def test_weighted_jaccard_by_hand(spark):
    r = random.Random(49)
    rows = [([r.randrange(9) for _ in range(r.randrange(12))], r.sample(range(12), r.randrange(1, 12)) if r.random() < 0.5 else [r.randrange(9) for _ in range(r.randrange(12))]) for _ in range(200)]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", decontaminate.weighted_jaccard("a", "b").alias("s")).collect()
    for x in got:
        common = sum((Counter(x["a"]) & Counter(x["b"])).values())
        assert abs(x["s"] - common / max(len(x["a"]) + len(x["b"]) - common, 1)) < 1e-12


def test_lanes_hold_each_bit_once():
    for longest in (1, 3, 11, 55, 75, 140, 1000, 5000):
        lanes = decontaminate._Lanes(longest, max(decontaminate.STRETCH, 4 * longest) + longest)
        assert sorted(b for bits in lanes.bits for b in bits) == list(range(64))


def test_op5_stays_in_the_jvm(spark):
    plan = decontaminate.op5_decontaminate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Window" in plan and not any(node in plan for node in ("InArrow", "InPandas", "EvalPython"))


def test_windows_in_steps_and_item_blocks(spark, monkeypatch):
    r = random.Random(47)
    known = [f"w{i}" for i in range(90)]
    items = [(i, " ".join(r.choice(known) for _ in range(n))) for i, n in enumerate([15, 15, 20, 140])]
    texts = [" ".join(r.choice(known) for _ in range(r.randrange(9))) + " " + r.choice(items)[1] + " " + r.choice(items)[1] for _ in range(12)] + [None, "", "w1"]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    docs = docs.withColumn("similarity", F.lit(1)).withColumn("words", F.lit("x"))
    whole = sorted(map(tuple, decontaminate.matches(docs, bench).collect()))
    assert len(whole) >= 12
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 1)
    assert sorted(map(tuple, decontaminate.matches(docs, bench).collect())) == whole
    index = decontaminate._Index([decontaminate._shingles(pa.array([t]))[0] for _, t in items], decontaminate.RADIUS)
    runs = []
    for step in (1, 1 << 14):
        monkeypatch.setattr(decontaminate, "STEP", step)
        runs.append(sorted(decontaminate._similar_windows(index, *decontaminate._shingles(pa.array(texts)), decontaminate.RADIUS, 0.8)))
    assert runs[0] == runs[1] and {(d, j) for d, j, *_ in runs[0]} == {(d, i) for d, i, *_ in whole}
    for empty in (decontaminate.matches(docs.limit(0), bench), decontaminate.matches(docs, bench.limit(0))):
        assert empty.collect() == [] and empty.columns == ["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"]


def test_index_tables_cover_the_radius():
    r = random.Random(48)
    index = decontaminate._Index([decontaminate._shingles(pa.array([" ".join(str(r.random()) for _ in range(20))]))[0] for _ in range(11)], decontaminate.RADIUS)
    for _, groups in index.sizes:
        for table, prints in groups:
            for _, bit, own in prints:
                for _ in range(100):
                    far = int(own[0])
                    for b in r.sample(range(64), decontaminate.RADIUS):
                        far ^= 1 << b
                    assert any(table[b][far >> 16 * b & 0xFFFF] & bit for b in range(decontaminate.BLOCKS))


def test_urls_by_hand(spark):
    r = random.Random(46)
    hosts = ["com", "Example.com", "example.net", "a.EXAMPLE.net", "org", "x.org", "net", "q.net", "notcom", "de.net.", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/70", "/en", "/de/8", "/de/", "/es/x", "/EN/"]
    tails = ["", "?a=1", "#f", "?x#y", "?http://com/en/"]
    urls = [r.choice(["http://", "HTTPS://", "//", "", "ftp://"]) + r.choice(hosts) + r.choice(paths) + r.choice(tails) for _ in range(400)] + [None, "", "://", "a://b://com/en/"]
    rules = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
    got = {x["page_id"]: x for x in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest)[0])
        path = re.split("[?#]", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, None))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best[1]), u
        assert got[i]["verdict"] == best[2] if best[2] else got[i]["verdict"] in ("allow", "block")


def chats_by_hand(rows):
    """conversation -> messages in order; the state of each is (place, hops)."""
    out = {}
    for conv in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == conv]
        read = lambda x: json.loads(x[3])
        call_of = {}
        for x in sorted(own, key=lambda x: x[1]):
            for c in read(x).get("tool_calls", []):
                call_of.setdefault(c["id"], x)
        state = {x: (x[1], 0) for x in own}
        for n in range(len(own) + 2):
            new = {}
            for x in own:
                up = call_of.get(read(x).get("tool_call_id"))
                new[x] = (x[1], 0) if up is None or state[up][0] < x[1] else (state[up][0], state[up][1] + 1)
            state, still = new, {x for x in own if new[x] != state[x]}
            if not still:
                break
        out[conv] = (own, state, call_of)
    return out


def test_messages_in_topological_order(spark):
    r = random.Random(47)
    rows = []
    for conv in range(30):
        ids = [f"i{k}" for k in range(6)]
        for turn in range(9):
            said = {"n": turn}
            up = r.choice([*ids, None, None])
            calls = r.sample(ids, r.choice([0, 0, 1, 2]))
            if calls:
                said["tool_calls"] = [{"id": c, "name": "f", "arguments": {}} for c in calls]
            if up:
                said["tool_call_id"] = up
            rows.append((conv, turn, "assistant", json.dumps(said)))
    got = {(x["conv_id"], x["turn"]): x["position"] for x in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    kept = 0
    for conv, (own, _, call_of) in chats_by_hand(rows).items():
        assert sorted(got[conv, x[1]] for x in own) == list(range(len(own)))
        for x in own:
            up = call_of.get(json.loads(x[3]).get("tool_call_id"))
            chain, at = [], x
            while at is not None and at not in chain:
                chain.append(at)
                at = call_of.get(json.loads(at[3]).get("tool_call_id"))
            if up is not None and at is None:  # no circle above
                assert got[conv, up[1]] < got[conv, x[1]]
                kept += 1
    assert kept > 30


def test_circles_keep_their_turns(spark):
    say = lambda call, up: json.dumps({"tool_calls": [{"id": call, "name": "f", "arguments": {}}], "tool_call_id": up})
    rows = [(1, 0, "a", say("p", "q")), (1, 1, "a", say("q", "p")), (1, 2, "tool", json.dumps({"tool_call_id": "p"})), (1, None, "user", "first")]
    got = {x["turn"]: x["position"] for x in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {None: 0, 0: 1, 1: 2, 2: 3}


def test_the_earliest_schema_counts(spark):
    """Whatever the order of rows; a list of types is checked."""
    tool = lambda *types: json.dumps({"tools": [{"name": "f", "parameters": {"properties": {"a": {"type": t}}}} for t in types]})
    calls = json.dumps({"tool_calls": [{"id": str(i), "name": "f", "arguments": {"a": a}} for i, a in enumerate(["x", 5, None, True])]})
    rows = [(1, 0, "system", tool(["string", "null"], "boolean")), (1, 1, "system", tool("integer")), (1, 2, "assistant", calls), (2, 5, "system", tool("integer")), (2, 6, "system", tool("string")), (2, 7, "assistant", calls), (3, None, "system", tool("boolean")), (3, 0, "system", tool("string")), (3, 1, "assistant", calls), (4, 0, "system", tool(["odd", "integer"])), (4, 0, "system", tool("string")), (4, 2, "assistant", calls)]
    for order in (rows, rows[::-1]):
        out = chat_format.format_chats(spark.createDataFrame(order, "conv_id long, turn int, role string, text string").coalesce(1)).where("kind = 'calls'")
        assert {x["conv_id"]: x["n_invalid"] for x in out.collect()} == {1: 2, 2: 3, 3: 3, 4: 3}


def test_schemas(spark):
    schema = {"name": "find", "parameters": {"properties": {"q": {"type": "string", "enum": ["x", "y"]}, "n": {"type": "integer"}, "l": {"type": "array", "items": {"type": "number"}}}, "required": ["q"], "additionalProperties": False}}
    loose = {"name": "loose", "parameters": {"properties": {"q": {"type": "string"}}, "additionalProperties": {"type": "string"}}}
    calls = [("find", {"q": "x"}, 0), ("find", {"q": "z"}, 1), ("find", {"q": "y", "n": 3, "l": [1, 2.5]}, 0), ("find", {"q": "y", "l": [1, "2"]}, 1), ("find", {"q": "x", "m": 1}, 1), ("find", {"q": None}, 1), ("gone", {}, 1), ("loose", {"z": 1}, 0), ("loose", {"q": 2}, 1), ("loose", {}, 0)]
    rows = [(1, -1, "system", json.dumps({"tools": [schema, loose]}))] + [(1, i, "assistant", json.dumps({"tool_calls": [{"id": str(i), "name": n, "arguments": a}]})) for i, (n, a, _) in enumerate(calls)] + [(2, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "gone", "arguments": {}}]}))]
    got = {(x["conv_id"], x["turn"]): x["n_invalid"] for x in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, i] for i in range(len(calls))] == [c[2] for c in calls] and got[2, 0] == 0


def test_a_callers_columns_stay(spark):
    df = spark.createDataFrame([(i, "the words of a text", "en", 5) for i in range(9)], "doc_id long, text string, lang string, _p long")
    out = language_id.identify(df)
    assert out.columns[:4] == df.columns and out.select("_p").distinct().collect()[0][0] == 5


def test_most_frequent_languages_are_learned(spark):
    rows = [(i, "common words here" if i % 10 else "seldom seen text " * 50, "aa" if i % 10 else "bb") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language_id.fit(df, "text", "lang", "doc_id", max_languages=1)) == {"aa"}
    assert set(language_id.fit(df, "text", "lang", "doc_id")) == {"aa", "bb"}


def test_places_in_split_groups(spark):
    rows = [(g, r) for g in (None, 1, 2) for r in range(200 if g == 1 else 7)]
    df = spark.createDataFrame(random.Random(48).sample(rows, len(rows)), "g long, r long")
    out = shared.places(df, "g", [F.col("r").desc()], "at").collect()
    assert all(x["at"] == ((200 if x["g"] == 1 else 7) - 1 - x["r"]) for x in out) and len(out) == len(rows)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def pipeline_rows(r, n=60):
    known = [f"word{i}" for i in range(400)]
    texts = [" ".join(r.choice(known) for _ in range(r.randrange(20, 70))) for _ in range(n)]
    rows = []
    for i in range(n):
        t = texts[i]
        if i % 6 == 1:
            t = texts[i - 1] + " more"
        if i % 6 == 2:
            t = texts[0][:150] + " " + t
        rows.append((None if i % 19 == 5 else i // 2 if i % 13 == 0 else i, t, "en", f"s{i % 4}", len(t)))
    return rows + [(900, None, "en", "s1", None), (901, "", "en", None, 0), (None, "only one", None, "s2", 8)]


def test_near_duplicates_by_hand(spark):
    rows = pipeline_rows(random.Random(49))
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()
    groups = components_by_hand([(j, x[1]) for j, x in enumerate(rows)], 5, 80, 100)
    assert len(got) == len({c for _, _, c in groups})
    of = {j: c for j, _, c in groups}
    left = {(x["doc_id"], x["text"]) for x in got}
    for c in set(of.values()):
        own = [rows[j] for j in of if of[j] == c]
        least = min(own, key=lambda x: (x[0] is None, x[0] or 0))
        assert sum((x[0], x[1]) in left for x in own) >= 1
        assert any((x[0], x[1]) in left for x in own if x[0] == least[0])


def test_repeated_spans_by_hand(spark):
    rows = [x for x in pipeline_rows(random.Random(50)) if x[0] is not None]
    rows = list({x[0]: x for x in rows}.values())
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.drop_repeated_spans(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    want = {i: sha for i, _, _, _, sha in brute_dedup(sorted((x[0], x[1]) for x in rows if x[1]), 100)}
    assert all(hashlib.sha256(got.get(i, "").encode()).hexdigest() == sha for i, sha in want.items())


def test_the_whole_pipeline(spark, tmp_path):
    r = random.Random(51)
    rows = [x for x in pipeline_rows(r) if x[1]]
    item = " ".join(f"item{i}" for i in range(30))
    rows.append((700, f"{rows[3][1]} {item}", "en", "s0", 0))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert k == 4 or set(docs.columns) == set(corpus_pipeline.COLUMNS)
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and not docs.where("text like '%item5 item6%'").count()
    out = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted(map(str, df.select("doc_id", "text", "copies", "taken").collect()))
    assert key(out) == key(docs)
    words = docs.select(F.size(F.split("text", " ")).alias("n"), "copies", "taken").collect()
    assert all(x["taken"] == x["n"] * x["copies"] <= 2 * x["n"] for x in words)
    by = docs.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(x["t"] - x["g"]) <= 40 for x in by)
    assert len(corpus_pipeline.STAGES) == 5


def test_empty_documents_through_the_pipeline(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
