"""The operators on vectors and words against plain versions of what they compute."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from threadloom.llm import embedding_dedup, spelling, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, _x int, _id int"


def vectors(spark, rows):
    """Vectors with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, label, "c", 7, 7, 7) for i, v, label in rows], VECTORS)


def codes_by_hand(rows, parts, entries, rounds, scale):
    kept = [(i, tuple(math.floor(scale * x) for x in v), label) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v: [min((far(x, e), k) for k, e in enumerate(books[p])) for p, x in enumerate(cut(v))]
    for _ in range(rounds):
        codes = [[k for _, k in assign(v)] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                if own := [cut(v)[p] for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == k]:
                    books[p][k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    out = [(i, "".join(f"{k:02x}" for _, k in assign(v)), sum(d for d, _ in assign(v)), label) for i, v, label in kept]
    sums = {label: sum(r[2] for r in out if r[3] == label) for label in {r[3] for r in out}}
    return sorted((str(i), c, e, str(label), sums[label]) for i, c, e, label in out), vector_codes.digest([np.array(b) for b in books])


@pytest.mark.parametrize("spread", [0.01, 1.0, 900.0])
def test_codes_by_hand(spark, spread):
    r = random.Random(int(spread * 100))
    rows = [(i // 2 if i % 10 == 0 else 1000 - i, [float(np.float32(r.choice([-1, 1]) * spread * r.choice([r.random(), 0.5]))) for _ in range(8)], r.choice([None, 1, 2])) for i in range(150)]
    rows += [rows[3], (None, rows[5][1], 1), (2000, None, 1), (2001, [], 1), (2002, [0.5] * 7 + [None], 1), (2003, [0.5] * 7 + [math.nan], 1), (2004, [-math.inf] * 8, 2), (2005, [0.25] * 8, None)]
    want, name = codes_by_hand(rows, 4, 16, 2, 256)
    out, _ = vector_codes.encode(vectors(spark, rows), parts=4, entries=16)
    got = out.collect()
    assert sorted((str(x["vec_id"]), x["code"], x["error"], str(x["label"]), x["label_error"]) for x in got) == want
    assert {x["codebooks_sha256"] for x in got} == {name}


def test_codes_of_other_shapes(spark):
    out, books = vector_codes.encode(vectors(spark, []), parts=4)
    assert out.count() == 0 and books == []
    rows = [(1, [1e30, -1e30, 0.0, 0.0], None), (2, [0.0] * 4, None), (3, [0.0] * 8, None), (4, [0.0] * 5, 1)]
    out, books = vector_codes.encode(vectors(spark, rows), parts=4)
    assert {x["vec_id"] for x in out.collect()} == {1, 2} and [len(b) for b in books] == [2] * 4


def test_nearest_is_exact():
    r = np.random.default_rng(3)
    for n in (1, 5, 7, 64, 200):
        entries = r.integers(-3, 4, (n, 3)) * r.choice([1, 1 << 20])
        points = r.integers(-4, 5, (500, 3)) * r.choice([1, 1 << 20])
        entry, apart = vector_codes.nearest(vector_codes.tree(entries), entries, points)
        all_ = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (entry == all_.argmin(1)).all() and (apart == all_.min(1)).all()


def near_by_hand(rows, least):
    ok = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok(v) and label is not None else None for _, v, label in rows]
    near = lambda i, j: unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least
    links = [[j for j in range(len(rows)) if j != i and near(i, j)] for i in range(len(rows))]
    out = []
    for i, (name, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        first = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((str(name), len(links[i]), str(first), name == first))
    return sorted(out)


@pytest.mark.parametrize(("size", "block", "list_rows"), [(16, 1024, 256), (20, 8, 30), (33, 5, 400)])
def test_near_duplicates_by_hand(spark, monkeypatch, size, block, list_rows):
    """A chain, a hot group, copies, odd vectors; blocks and lists far smaller than the groups."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "LIST_ROWS", list_rows)
    r = np.random.default_rng(size)
    rows = [(i, r.normal(size=size).tolist(), int(r.integers(3))) for i in range(250)]
    hot, turn = r.normal(size=size), r.normal(size=size)
    rows += [(300 + i, (hot + 0.09 * r.normal(size=size)).tolist(), 1) for i in range(60)]
    rows += [(400 + i, (hot * math.cos(i / 7) + turn * math.sin(i / 7)).tolist(), 2) for i in range(12)]
    rows += [(500 + i % 7, rows[3][1], i % 2) for i in range(14)] + [(600, rows[3][1], None), (601, [0.0] * size, 1), (602, None, 1), (603, [], 1), (604, [math.nan] * size, 1), (605, [None] * size, 1), (None, rows[4][1], rows[4][2]), (None, None, None), (606, [1.0] * 4, 1), (607, [2.0] * 4, 1), (608, [1e-30] * size, 0), (609, [1e30] * size, 0)]
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = embedding_dedup.near_duplicates(vectors(spark, rows).repartition(5)).collect()
    assert sorted((str(x["vec_id"]), x["n_links"], str(x["component_id"]), x["kept"]) for x in got) == [(a, b, c, a == c) for a, b, c, _ in near_by_hand(rows, 0.98)]


def test_near_duplicates_of_nothing(spark):
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0
    assert [tuple(x) for x in embedding_dedup.near_duplicates(vectors(spark, [(1, None, 1), (2, [0.5], None)])).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
    assert [tuple(x) for x in embedding_dedup.near_duplicates(vectors(spark, [(2, [0.5], 1), (1, [0.25], 1)])).orderBy("vec_id").collect()] == [(1, 1, 1, True), (2, 1, 1, False)]


def test_codes_bound_distances():
    """Lists that are probed, and looked-up distances, leave no near pair out; most others are."""
    r = np.random.default_rng(8)
    x = r.normal(size=(600, 24))
    x = np.concatenate([x, x[:200] + 0.11 * r.normal(size=(200, 24))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    index, reach = embedding_dedup.fit(x[::3], 12), 0.2
    x = np.pad(x, ((0, 0), (0, index.width - 24)))
    lists = index.lists(x)
    _, square, error = index.codes(x, lists)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= reach**2
    probes = np.stack([index.probes(x[i : i + 1], lists[i], reach)[0] for i in range(len(x))])
    assert near.sum() > len(x) and (probes[:, lists] | ~near).all() and probes.mean() < 0.9
    assert (error < 1).all() and np.isfinite(square).all()


def variants_by_hand(counts, factor):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, []
    for w, n in counts.items():
        others = sorted((-counts[o], o) for o in counts if o != w and near(w, o))
        form[w] = others[0][1] if others and -others[0][0] >= factor * n else None
        out.append((w, len(others)))
    root = lambda w: w if form[w] is None else root(form[w])
    return sorted((w, str(form[w]), root(w), counts[w], n, str(counts.get(form[w]))) for w, n in out)


@pytest.mark.parametrize("alphabet", ["ab", "abcdeé", "aaab\U0001F600"])
def test_variants_by_hand(spark, monkeypatch, alphabet):
    monkeypatch.setattr(spelling, "KEYS", 40)
    monkeypatch.setattr(spelling, "BUCKET_KEYS", 50)
    r = random.Random(len(alphabet))
    counts = {"".join(r.choice(alphabet) for _ in range(r.randrange(1, 7))): r.choice([1, 2, 3, 30, 400, 5000]) for _ in range(250)} | {"": 3}
    got = spelling.variants(spark.createDataFrame([(7, w, n, "x") for w, n in counts.items()], "uid long, word string, n long, form string"))
    assert sorted((x["word"], str(x["form"]), x["root"], x["n"], x["n_near"], str(x["form_n"])) for x in got.collect()) == variants_by_hand(counts, 10)
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_a_very_long_word(spark):
    long = "ab" * 20_000 + "c" * 20_000
    got = spelling.variants(spark.createDataFrame([(long, 2), (long + "d", 30), (long.replace("bc", "dc"), 300)], "word string, n long")).collect()
    assert {(x["n"], x["form_n"], x["n_near"], len(x["root"])) for x in got} == {(2, 300, 2, 60_000), (30, None, 1, 60_001), (300, None, 1, 60_000)}


def test_words_by_hand(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "HELD", 20)
    r = random.Random(5)
    some = ["Straßen", "ÀÉÎõü×÷", "letters", "LETTERS", "Colour", "colouring", "x", "İstanbul", "naïveté", "ﬁrst-rate", "a\u0301bcdefg", "don't"] + ["".join(r.choice("abcdefgÄö") for _ in range(r.randrange(5, 12))) for _ in range(60)]
    rows = [(r.choice([i, i, None]), "".join(r.choice(some) + r.choice([" ", ", ", "7", "\n", "—"]) for _ in range(r.randrange(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "unbroken" * 4000), (502, "unbroken" * 4000)]
    want = Counter()
    for i, t in rows:
        for raw in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            want[w] += len(w) >= 7
    frame = spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id long, text string, word string, n long")
    assert {x["word"]: x["n"] for x in spelling.words(frame).collect()} == {w: n for w, n in want.items() if n}
    assert spelling.words(frame.limit(0)).count() == 0
