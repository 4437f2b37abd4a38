"""The text kernel, near duplicates, substrings, decontamination and language model scores against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same, connection
from pyspark.sql import functions as F

from cuegrid.llm import common, hmm, op3_jaccard, op5_lmscore, op8_substrings, op9_decontaminate
from cuegrid.llm.components import components

DOCS = "doc_id long, text string, lang string, n_chars long, component_id string, c1 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", 1, "x", "y") for i, t in zip(ids, texts, strict=True)], DOCS)


ODD = ["", None, " \t\n", "one", "a b c d", "ÄÖ ß é x", "Same text here for all of them now", "Same text here for all of them now", "same TEXT here for all of them now", "\x1c\x85 　 z", "w " * 3000]


def words(text, lower=False):
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORD.findall(text or "")


def test_word_hashes_tell_words_apart():
    rng = random.Random(0)
    texts = ["".join(rng.choice(" \t\nabABé ") for _ in range(rng.randrange(40))) for _ in range(400)] + ["", None]
    for lower in (True, False):
        known, back = {}, {}
        for at, data, offsets in common.text_slices(pa.array(texts, pa.string()).slice(3)):
            h, bounds, starts, ends = common.word_hashes(data, offsets, lower)
            for k in range(len(bounds) - 1):
                want = words(texts[3 + at + k], lower)
                got = h[bounds[k] : bounds[k + 1]].tolist()
                assert len(got) == len(want)
                for a, b in zip(got, want, strict=True):
                    assert known.setdefault(a, b) == b and back.setdefault(b, a) == a
            raw = data.tobytes()
            assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == [w for t in texts[3:] for w in words(t)]


def test_window_hashes_and_sliding():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 3, 300).astype(np.uint64)
    h = common.window_hashes(w, 4)
    seen = {}
    for k in range(len(h)):
        assert seen.setdefault(int(h[k]), w[k : k + 4].tolist()) == w[k : k + 4].tolist()
    assert len(seen) == len({tuple(w[k : k + 4].tolist()) for k in range(297)})
    for size in (1, 2, 5, 38):
        assert common.sliding(w, size, np.minimum).tolist() == [w[k : k + size].min() for k in range(len(w) - size + 1)]


def test_join_texts_equals_a_plain_join(spark):
    docs = frame(spark, [f"t{k}" for k in range(50)] + ["null"], [*range(50), None])
    side = common.materialise(spark.createDataFrame([(k, k * 2) for k in range(0, 80, 3)], "doc_id long, v long"), "side")
    for how in ("inner", "left", "left_anti"):
        got = sorted(map(tuple, common.join_texts(docs, side, "doc_id", how).select("doc_id", "text", *(["v"] if how != "left_anti" else [])).collect()), key=str)
        want = sorted(map(tuple, docs.join(side, "doc_id", how).select("doc_id", "text", *(["v"] if how != "left_anti" else [])).collect()), key=str)
        assert got == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    got = {r.node: r.root for r in components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert set(got) == nodes and all(find(got[x]) == find(x) and got[got[x]] == got[x] for x in nodes)
    assert len(set(got.values())) == len({find(x) for x in nodes})


# --- n-gram Jaccard join ---


def brute_groups(texts, ids):
    sets = []
    for t in texts:
        w = words(t, True)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), len(s), str(least.get(find(k)) if s else i)) for k, (i, s) in enumerate(zip(ids, sets, strict=True)))


def near_texts(rng, groups=6, copies=9):
    out = []
    vocabulary = [f"w{k}" for k in range(60)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    return out


def test_jaccard_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op3_jaccard, "COMMON", 4)
    rng = random.Random(5)
    line = "this line stands in many of the documents as it is"
    texts = ODD + near_texts(rng) + [f"{line} {' '.join(rng.choice('abcdefgh') + str(rng.randrange(99)) for _ in range(12))}" for _ in range(40)]
    ids = [*range(100, 100 + len(texts))]
    ids[3], ids[20] = None, 5
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in op3_jaccard.near_duplicates(frame(spark, texts, ids)).collect())
    assert got == brute_groups(texts, ids)


def test_jaccard_in_pieces(spark):
    """Trees and pieces of a few rows, so that blocks and clusters are split."""
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = []
    for k in range(70):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += near_texts(rng) + [" ".join(base[:40] + [rng.choice(vocabulary) for _ in range(60)]) for _ in range(30)]
    ids = [*range(len(texts))]
    for sizes in ({"tree_rows": 8, "piece": 4}, {"tree_rows": 200, "piece": 16}, {"piece_shingles": 500}):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in op3_jaccard.Join(frame(spark, texts, ids), **sizes).result().collect())
        assert got == brute_groups(texts, ids)


def test_classes_of_one_first_half_stay_apart():
    c1, c2 = np.array([7, 7, 9]), np.array([1, 2, 3])
    assert op3_jaccard.class_names(c1, c2, np.zeros(0, np.int64)).tolist() == [7, 7, 9]
    assert op3_jaccard.class_names(c1, c2, np.array([7])).tolist() == [7 ^ 1, 7 ^ 2, 9]


@pytest.mark.parametrize("own", [54, 64])
def test_near_misses_share_no_block(spark, own):
    """Texts of one template with a Jaccard index of about 0.74 and 0.70, of which none link: what is compared grows
    with their number, not with its square. A few that do link are found among them."""
    template = [f"t{k}" for k in range(300)]
    for m in (300, 600):
        texts = [" ".join([*template, *(f"u{m}.{d}.{k}" for k in range(own))]) for d in range(m)]
        near = [" ".join([*template, *(f"u{m}.{d}.{k}" for k in range(own - 30)), *(f"v{d}.{k}" for k in range(30))]) for d in (3, 5)]
        join = op3_jaccard.Join(frame(spark, texts + near), piece=64)
        blocks, placed = join.blocks().count(), join.searched().groupBy("node").count().agg({"count": "max"}).first()[0]
        assert blocks < 4 * m and (placed or 0) <= 8, (m, blocks, placed)
        got = {r.doc_id: r.component_id for r in join.result().collect()}
        assert {k: v for k, v in got.items() if k != v} == {m: 3, m + 1: 5}


def test_jaccard_of_rows_without_ids(spark):
    texts = near_texts(random.Random(8))
    for ids in ([None] * len(texts), [k if k % 3 == 0 else None for k in range(len(texts))]):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in op3_jaccard.near_duplicates(frame(spark, texts, ids)).collect())
        assert got == brute_groups(texts, ids)


def test_jaccard_of_nothing(spark):
    assert op3_jaccard.near_duplicates(frame(spark, [])).collect() == []
    assert [tuple(r) for r in op3_jaccard.near_duplicates(frame(spark, [None, "", "x"])).orderBy("doc_id").collect()] == [(0, 0, 0), (1, 0, 1), (2, 1, 2)]


def test_trees_find_every_possible_pair():
    rng = np.random.default_rng(2)
    vectors = rng.poisson(3, (600, op3_jaccard.GROUPS)).astype(np.uint32)
    vectors[1::7] = vectors[::7][: len(vectors[1::7])]
    sizes = vectors.sum(1).astype(np.int64)
    block = np.sort(rng.choice([0, 1, 1, 1, 2, 3], 600))
    side = rng.integers(0, 5, 600)
    for inner in (np.zeros(600, bool), np.ones(600, bool), block == 1):
        order = np.lexsort((-sizes, side, block))
        v, n, s, i = vectors[order], sizes[order], side[order], inner[order]
        forest = op3_jaccard.Forest(block, s, i, n, v)
        assert len(forest.levels) > 1
        got = sorted(x for a, b in forest.pairs() for x in zip(a.tolist(), b.tolist(), strict=True))
        want = []
        for k in range(600):
            bound = np.minimum(v, v[k]).sum(1)
            ok = (7 * bound >= 3 * (n + n[k])) & (4 * n >= 3 * n[k]) & (3 * n <= 4 * n[k]) & (block == block[k]) & (i[k] | (s != s[k]))
            want += [(k, j) for j in np.flatnonzero(ok).tolist() if j > k]
        assert got == want


def test_bounds_are_never_too_small():
    rng = random.Random(3)
    points, sets = [], []
    for _ in range(60):
        a = {rng.getrandbits(20) for _ in range(rng.choice([5, 200, 700, 900, 3000]))}
        b = {x for x in a if rng.random() < rng.choice([0.8, 0.9, 1])}
        for x in (a, b):
            sets.append(x)
            points.append(op3_jaccard.point(np.array(sorted(x), np.uint64), op3_jaccard.group_count(len(x))))
            assert op3_jaccard.unpacked(op3_jaccard.packed(points[-1])).tolist() == points[-1].tolist()
    sizes = np.array([len(x) for x in sets])
    a, b = (x.ravel() for x in np.triu_indices(len(sets), 1))
    coarse = np.array([op3_jaccard.folded(p, op3_jaccard.GROUPS) for p in points])
    overlap = np.array([len(sets[i] & sets[j]) for i, j in zip(a, b, strict=True)])
    assert (op3_jaccard.bound_of(coarse[a], coarse[b]) >= overlap).all()
    link = 7 * overlap >= 3 * (sizes[a] + sizes[b])
    kept = op3_jaccard.finer(points, sizes, a, b)
    assert kept[link].all() and not kept[overlap < sizes[a] * 0.3][sizes[a][overlap < sizes[a] * 0.3] > 600].all()


def test_linked_groups():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 300)
    sets = [np.unique(np.concatenate([base[rng.random(300) > 0.12], rng.integers(0, 1 << 60, rng.integers(0, 30))])) for _ in range(40)]
    home = rng.random(40) > 0.3
    group = op3_jaccard.linked_groups(home, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
    label = list(range(40))
    for _ in range(40):
        for i in range(40):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if (home[i] or home[j]) and 7 * o >= 3 * (len(sets[i]) + len(sets[j])):
                    label[i] = label[j] = min(label[i], label[j])
    assert group.tolist() == label and len(set(label)) > 1


# --- substrings ---


def brute_substrings(texts, ids):
    first = {}
    for i, t in zip(ids, texts, strict=True):
        w = words(t)
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in zip(ids, texts, strict=True):
        w = words(t)
        gone = {p for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out)


def passages(rng):
    shared = [[f"p{k}_{j}" for j in range(n)] for k, n in enumerate((49, 50, 51, 80, 200))] + [["rep"] * 130]
    texts = []
    for k in range(60):
        w = []
        for _ in range(rng.randrange(4)):
            w += [f"u{k}_{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]
            s = rng.choice(shared)
            a = rng.randrange(max(1, len(s) - 60))
            w += s[a : a + rng.choice([50, 60, 500])]
        texts.append(" \n".join(w))
    return texts + texts[:5] + texts[:3]


def test_substrings_against_brute_force(spark):
    rng = random.Random(6)
    texts = ODD + passages(rng)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[-1], ids[30] = ids[-2], None
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in op8_substrings.digest(frame(spark, texts, ids)).collect())
    assert got == brute_substrings(texts, ids)


def test_substrings_of_nothing(spark):
    assert op8_substrings.digest(frame(spark, [])).collect() == []


def test_deduplicated_keeps_columns(spark):
    rng = random.Random(7)
    docs = frame(spark, passages(rng) + ODD)
    want = {r.doc_id: r for r in op8_substrings.digest(docs).collect()}
    got = {r.doc_id: r for r in op8_substrings.deduplicated(docs).collect()}
    assert op8_substrings.deduplicated(docs).columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, w in want.items():
        if w.n_removed == 0:
            assert got[i].text == texts[i]
        elif w.n_removed == w.n_words:
            assert i not in got
        else:
            assert hashlib.sha256(got[i].text.encode()).hexdigest() == w.kept_sha256 and got[i].n_chars == len(got[i].text)


def test_deduplicated_with_columns_named_like_its_own(spark):
    names = ["cuts", "_at", "_word", "word", "bits", "Bits", "score", "places"]
    docs = frame(spark, passages(random.Random(7)) + ODD).select("doc_id", "text", *(F.col("doc_id").alias(c) for c in names if c != "Bits"))
    got = op8_substrings.deduplicated(docs)
    assert got.columns == docs.columns and all(r.cuts == r.word == r.places == r.doc_id for r in got.collect()) and got.count() > 60


def test_every_window_has_a_seed_at_the_same_place():
    rng = np.random.default_rng(8)
    run = rng.integers(0, 4, 50).astype(np.uint64)
    places = set()
    for _ in range(20):
        w = np.concatenate([rng.integers(0, 4, rng.integers(0, 70)).astype(np.uint64), run, rng.integers(0, 4, rng.integers(0, 70)).astype(np.uint64)])
        at = next(k for k in range(len(w) - 49) if (w[k : k + 50] == run).all())
        s = op8_substrings.seeds_of(w, np.array([0, len(w)]))
        inside = s[(s >= at) & (s <= at + 37)] - at
        short = common.window_hashes(run, op8_substrings.BASE)
        assert np.flatnonzero(short == short.min())[0] in inside
        places.add(int(np.flatnonzero(short == short.min())[0]))
    assert len(places) == 1


# --- decontamination ---


def brute_distance(item, text):
    best = list(range(len(item) + 1))
    low = best[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(best[i] + 1, new[-1] + 1, best[i - 1] + (x != c)))
        best = new
        low = min(low, best[-1])
    return low


def test_decontamination_against_brute_force(spark):
    rng = random.Random(9)
    item = lambda n: "".join(rng.choice("abcdef gh") for _ in range(n))
    items = [(k, item(rng.choice([25, 60, 130]))) for k in range(12)] + [(90, None), (91, ""), (92, "tiny one"), (93, None), (96, "q"), (None, "gh")]
    items.append((95, items[0][1]))
    texts = list(ODD)
    for _ in range(60):
        t = list(rng.choice(items[:12])[1])
        for _ in range(rng.randrange(0, len(t) // 8)):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(2)] = rng.choice(["", "z", "q r"])
        texts.append(f"{item(30)}  {''.join(t).upper()}\n{item(30)}")
    texts += ["one tiny  ONE", "one tiny ones", "tiny one", "a q", "aq q", "gh", "gha gh"]
    got = {(r.doc_id, r.item_id): r.distance for r in op9_decontaminate.leaks(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, x in items:
            n = op9_decontaminate.normal(x or "")
            if 0 < len(n) < op9_decontaminate.SHORT:
                if f" {n} " in f" {op9_decontaminate.normal(t or '')} ":
                    want[d, i] = 0
            elif n and (e := brute_distance(n, op9_decontaminate.normal(t or ""))) <= int(op9_decontaminate.ERROR_RATE * len(n)):
                want[d, i] = e
    assert got == want and len(want) > 20


def test_blocks_of_items(spark):
    bench = spark.createDataFrame([(k, f"item {k} " * 5) for k in range(40)], "item_id long, text string")
    blocks = list(op9_decontaminate.item_blocks(bench, 300))
    assert len(blocks) > 3 and sorted(t for b in blocks for _, t in b) == sorted(f"item {k} " * 5 for k in range(40))
    assert len({i for b in blocks for i, _ in b}) == 40
    assert op9_decontaminate.leaks(frame(spark, ["x"]), bench.limit(0)).collect() == []


# --- language model ---


def test_likelihood_is_exact():
    rng = np.random.default_rng(10)
    m = hmm.estimate(hmm.Counts(rng.random(3), rng.random((3, 3)), rng.random((5, 3))), np.full(5, 0.2))
    rows = [rng.integers(0, 5, n) for n in (1, 4, 7, 300)]
    got = hmm.log10_likelihood(m, np.concatenate(rows), np.cumsum([0, *map(len, rows)]))
    for r, g in zip(rows, got, strict=True):
        a, total = m.first * m.emit[r[0]], 0.0
        for s in r[1:]:
            total += math.log10(a.sum())
            a = (a / a.sum()) @ m.move * m.emit[s]
        assert g == pytest.approx(total + math.log10(a.sum()))


def test_expected_counts_are_exact():
    rng = np.random.default_rng(11)
    m = hmm.estimate(hmm.Counts(rng.random(2), rng.random((2, 2)), rng.random((3, 2))), np.full(3, 1 / 3))
    r = [2, 0, 1, 1]
    c = hmm.Counts.none(2, 3)
    hmm.expected(m, np.array(r), np.array([0, 4]), c)
    emit, move, total = np.zeros((3, 2)), np.zeros((2, 2)), 0.0
    for code in range(16):
        path = [code >> k & 1 for k in range(4)]
        p = m.first[path[0]] * m.emit[r[0], path[0]]
        for k in range(1, 4):
            p *= m.move[path[k - 1], path[k]] * m.emit[r[k], path[k]]
        total += p
        for k in range(4):
            emit[r[k], path[k]] += p
        for k in range(1, 4):
            move[path[k - 1], path[k]] += p
    assert c.emit == pytest.approx(emit / total, rel=1e-4) and c.move == pytest.approx(move / total, rel=1e-4)


def test_expected_counts_of_whole_rows():
    """Rows longer than a block, more rows than run side by side, against a loop over one row at a time."""
    rng = np.random.default_rng(12)
    m = hmm.estimate(hmm.Counts(rng.random(3), rng.random((3, 3)), rng.random((5, 3))), np.full(5, 0.2))
    rows = [rng.integers(0, 5, n) for n in (1, 40, 0, 17, 16, 33, 9, 40)]
    got = hmm.Counts.none(3, 5)
    hmm.expected(m, np.concatenate(rows), np.cumsum([0, *map(len, rows)]), got, width=3, block=8)
    want = hmm.Counts.none(3, 5)
    for r in rows:
        if not len(r):
            continue
        a, b = [m.first * m.emit[r[0]]], [np.ones(3)]
        for s in r[1:]:
            a.append((a[-1] / a[-1].sum()) @ m.move * m.emit[s])
        for s in r[:0:-1]:
            b.append(m.move @ (m.emit[s] * b[-1] / b[-1].sum()))
        b.reverse()
        for t, s in enumerate(r):
            g = a[t] * b[t] / (a[t] * b[t]).sum()
            want.emit[s] += g
            if t:
                x = a[t - 1][:, None] * m.move * (m.emit[s] * b[t])[None]
                want.move += x / x.sum()
            else:
                want.first += g
    assert got.emit == pytest.approx(want.emit, rel=1e-4) and got.move == pytest.approx(want.move, rel=1e-4) and got.first == pytest.approx(want.first, rel=1e-4)


BASE_SQL = r"""
WITH d AS (SELECT doc_id, list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), '') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t SEMI JOIN training USING (doc_id) GROUP BY w),
a AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base_score FROM t LEFT JOIN c USING (w), a GROUP BY doc_id"""


def test_base_scores_of_the_table_against_sql(spark, sf_dir):
    con = connection(sf_dir)
    ids = [r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall()]
    con.execute("CREATE TABLE training(doc_id BIGINT)")
    con.executemany("INSERT INTO training VALUES (?)", [[i] for i in ids if zlib.crc32(str(i).encode()) % 7 != 2])
    want = {r[0]: r[1:] for r in con.execute(BASE_SQL).fetchall()}
    got = {r.doc_id: r for r in op5_lmscore.op5_lm_scoring(spark, sf_dir).collect()}
    assert set(got) == set(want) == set(ids)
    for i, (n, known, total, base) in want.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total) and got[i].base_score == pytest.approx(base)


@pytest.mark.parametrize("lexicon", [1 << 19, 40])
def test_scores_against_a_plain_forward_pass(spark, monkeypatch, lexicon):
    monkeypatch.setattr(op5_lmscore, "LEXICON", lexicon)
    monkeypatch.setattr(op5_lmscore, "LEAST_SYMBOLS", 30)
    rng = random.Random(13)
    texts = ODD + [" ".join(f"W{rng.randrange(int(10 ** rng.uniform(1, 3)))}" for _ in range(rng.randrange(90))) for _ in range(40)]
    docs = frame(spark, texts)
    trained = op5_lmscore.Trained(docs)
    lex, m = trained.lexicon, trained.model
    symbol = dict(zip(lex.small.tolist(), lex.small_symbol.tolist(), strict=True))
    count = {r.h & (1 << 64) - 1: r.c for r in trained.counts.collect()}
    got = {r.doc_id: r.score for r in op5_lmscore.score(docs, trained).collect()}
    assert len(symbol) < len(count)
    for i, text in enumerate(texts):
        ((_, h, _, kind),) = op5_lmscore.tokens(pa.array([text], pa.string()))
        a, total = m.first, 0.0
        for t, (x, k) in enumerate(zip(h.tolist(), kind.tolist(), strict=True)):
            p = m.emit[symbol[x]] if x in symbol else m.emit[lex.known + k] * (count.get(x, 0) + 1) / 10 ** lex.kind_logs[k]
            a = (a @ m.move if t else a) * p
            total += math.log10(a.sum())
            a = a / a.sum()
        assert got[i] == pytest.approx(total)


@pytest.mark.parametrize("lexicon", [1 << 19, 40])
def test_base_scores_against_counts(spark, sf_dir, monkeypatch, lexicon):
    monkeypatch.setattr(op5_lmscore, "LEXICON", lexicon)
    monkeypatch.setattr(op5_lmscore, "LEAST_SYMBOLS", 30)
    rng = random.Random(12)
    texts = ODD + [" ".join(f"W{rng.randrange(int(10 ** rng.uniform(1, 4)))}" for _ in range(rng.randrange(200))) for _ in range(60)]
    ids = [*range(len(texts) - 1), None]
    tok = lambda t: [*words(t, True), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in zip(ids, texts, strict=True) if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in op5_lmscore.score(frame(spark, texts, ids)).collect()}
    for i, t in zip(ids, texts, strict=True):
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t))) and g.score < 0


def test_model_beats_the_base_on_held_out_text(spark, sf_dir):
    rows = op5_lmscore.op5_lm_scoring(spark, sf_dir).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_scores_of_nothing(spark):
    assert op5_lmscore.score(frame(spark, [])).collect() == []


@pytest.mark.parametrize("module,name", [(op3_jaccard, "op3_jaccard_join"), (op8_substrings, "op8_substring_dedup")])
def test_same_rows_as_sql(spark, sf_dir, module, name):
    assert_same(module.QUERIES[name](spark, sf_dir), connection(sf_dir), module.ORACLES[name])
