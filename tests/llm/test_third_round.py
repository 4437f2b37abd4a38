"""Repair of conversations, toxicity and hard negatives against brute force, held-out labels and defined cases."""

import hashlib
import heapq
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from compare import assert_same, connection

from cuegrid.llm import channel, minplus
from cuegrid.llm import op11_repair as repair
from cuegrid.llm import op12_toxicity as toxicity
from cuegrid.llm import op13_negatives as negatives

INK = re.compile(r"[^\x20\x09-\x0D]")


# --- op11 ---


def cheapest(rows):
    """(cost, audit) by a search over (rows used, state), the cheapest first, then the least audit."""
    steps = {(i, r): j for i, r, j in minplus.STEPS}
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, k, state = heapq.heappop(heap)
        if k == len(rows) and state in (0, 3):
            return cost, audit
        if (k, state) in done:
            continue
        done.add((k, state))
        for role in "ua":
            if (j := steps.get((state, role))) is not None:
                heapq.heappush(heap, (cost + 3, audit + "I", k, j))
        if k < len(rows):
            initial, truncated, gone = rows[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, state))
            if not gone:
                more = 3 if truncated else 0
                if (j := steps.get((state, initial))) is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, j))
                for role in "ua":
                    if (j := steps.get((state, role))) is not None:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", k + 1, j))


def plain_report(rows):
    """The report of one conversation's rows (turn, role, text), which are damaged already."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        ink = INK.findall(text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = cheapest([(r[1][:1], f == "truncated", f in ("blank", "duplicate")) for r, f in zip(rows, faults, strict=True)])
    out, k = [], 0
    for edit in audit:
        due = "assistant" if out and out[-1].startswith("u") else "user"
        if edit == "I":
            out.append(f"{due}:")
        else:
            _, role, text = rows[k]
            k += 1
            if edit != "D":
                out.append(f"{role if edit == 'K' else due}:{text}")
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def random_rows(r, conv, n):
    texts = ["a.", "b!", "c", "", " \t", None, "long text without end", "Ü?"]
    return [(conv, r.choice([None, *range(n)]), r.choice(["user", "assistant", "system", "tool", None, ""]), r.choice(texts)) for _ in range(n)]


def plain_damage(rows):
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        for _ in range(2 if fault == 3 else 1):
            yield conv, turn, "user" if fault == 4 else role, text


@pytest.mark.parametrize("fan", [2, 32])
def test_repair_equals_search(spark, monkeypatch, fan):
    monkeypatch.setattr(repair, "FAN", fan)
    r = random.Random(11)
    rows = [x for conv in [*range(60), None] for x in random_rows(r, conv, r.choice([1, 2, 3, 8]))] + random_rows(r, 77, 300) + [(78, 5, "user", "same.")] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {x.conv_id: tuple(x)[1:] for x in repair.report(repair.damaged(df), df).collect()}
    by = {c: [] for c in {x[0] for x in rows}}
    for conv, *rest in plain_damage(rows):
        by[conv].append(tuple(rest))
    assert got == {c: plain_report(x) for c, x in by.items()}


def test_repaired_rows_are_legal(spark):
    r = random.Random(5)
    rows = [x for conv in range(30) for x in random_rows(r, conv, 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    planned = repair.plans(repair.flagged(df))
    roles = {}
    for x in sorted(repair.repaired(df, planned).collect(), key=lambda x: (x.conv_id, x.place)):
        roles.setdefault(x.conv_id, []).append(x.role[0])
    assert roles and all(re.fullmatch("s?(ua)+", "".join(x)) for x in roles.values())


def test_matrix_products_are_associative():
    r = np.random.default_rng(3)
    every = minplus.kinds()
    for n in (1, 2, 7, 30):
        m = every[r.integers(0, len(every), n)]
        whole = minplus.reduced(m, np.zeros(n, int))
        left = m[:1]
        for k in range(1, n):
            left = minplus.product(left, m[k : k + 1])
        assert (whole.cost == left.cost).all() and (whole.audit == left.audit).all()


def test_repair_of_nothing_and_odd_columns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(repair.damaged(empty), empty).count() == 0
    dropped = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, dropped, "user", "a.", "x", 1)], "conv_id long, turn long, role string, text string, fault string, digest int")
    assert [tuple(x) for x in repair.report(repair.damaged(df), df).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_equals_sql(spark, sf_dir):
    assert assert_same(repair.op11_conversation_repair(spark, sf_dir), connection(sf_dir), repair.ORACLES["op11_conversation_repair"]) > 0


# --- op12 ---


@lru_cache
def model_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return channel.log_model(channel.trigram_counts(data, np.array([0, len(data)])))


TEXT = "you are an idiot and a moron so stupid a loser with scum and trash in a pathetic clown worthless disgusting you are not the one " * 20


@pytest.mark.parametrize(
    "written, meant",
    [("1d10t", "idiot"), ("m0r0n!", "moron"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("stuuupid", "stupid"), ("$cum", "scum"), ("tr@sh", "trash"), ("l000ser", "loser"), ("STUUUP1D", "stupid"), ("p4th3t1c", "pathetic"), ("5 t u p 1 d", "stupid"), ("idiot", "idiot"), ("a plain text, 12 times", "a plain text, 12 times")],
)
def test_disguises_are_read(written, meant):
    assert channel.restored(f"so {written} then", model_of(TEXT)).split("so ")[1].split(" then")[0].replace("!", "") == meant


def test_viterbi_equals_all_readings():
    model, r = model_of(TEXT), random.Random(2)

    def all_readings(stretch):
        lone = max(len(x) for x in re.split(r"[ \t\n._*\-]+", stretch)) <= 1
        now, before, run = {((0, 0), ""): 0.0}, "", 0
        for c in stretch:
            run = run + 1 if c == before and (c.isalpha() or c in channel.LOOKS_LIKE) else 0
            before = c
            options = channel._choices(c, lone)
            options = [(None, 0.0)] if run >= 2 else [(s, p + channel.DOUBLE_MEANT) for s, p in options] + [(None, channel.DOUBLE_DROPPED)] if run == 1 else options
            new = {}
            for (state, out), score in now.items():
                for symbol, p in options:
                    if symbol is None or symbol == 0 and state[1] == 0:
                        key, s = (state, out), score + p
                    else:
                        key, s = ((state[1], symbol), out + (" " if symbol == 0 else chr(96 + symbol))), score + p + model[state[0], state[1], symbol]
                    new[key] = max(s, new.get(key, -1e9))
            now = new
        best = max(s + model[k[0][0], k[0][1], 0] for k, s in now.items())
        return {k[1].strip() for k, s in now.items() if s + model[k[0][0], k[0][1], 0] > best - 1e-9}

    for _ in range(200):
        stretch = "".join(r.choice("a1i0o$!5s") for _ in range(r.randint(2, 8)))
        assert channel.decode(stretch, model) in all_readings(stretch), stretch


def test_no_disguise_is_overlooked():
    r = random.Random(4)
    texts = ["".join(r.choice("ab1$! .é") for _ in range(r.randint(0, 12))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    marked = channel.disguised_rows(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert all(m for t, m in zip(texts, marked, strict=True) if channel.stretches(t))


def test_trigrams_equal_a_plain_count():
    texts = ["ab", "", "A é", "zz z"]
    raw = [t.encode() for t in texts]
    got = channel.trigram_counts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    kind = lambda b: b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 0 if b in b" \t\n\r\x0b\x0c" else 27
    line = [0, 0]
    for x in raw:
        line += [kind(b) for b in x] + [0, 0]
    line = line[: len(got) and 2 * len(texts) + sum(map(len, raw)) + 1]
    want = np.zeros(28**3, int)
    for a, b, c in zip(line, line[1:], line[2:], strict=False):
        want[(a * 28 + b) * 28 + c] += 1
    assert (got == want).all()


def test_long_tokens_take_linear_time():
    import time

    began = time.time()
    channel.restored("a1" * 20_000 + " " + "x y " * 20_000, model_of(TEXT))
    assert time.time() - began < 20


def test_toxicity_of_held_out_documents(spark, sf_dir):
    got = {r.doc_id: r for r in toxicity.op12_toxicity(spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if got.get(r.doc_id) and got[r.doc_id].held_out}
    assert np.mean([got[k].predicted == v for k, v in labels.items()]) > 0.9


def test_toxicity_reads_disguises_and_defined_cases(spark):
    words = "the and of to in is that for on with as by at from this be are it was or".split()
    r = random.Random(8)
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(k, f"{prose(30)} {'stupid idiot' if k % 4 == 0 else ''} {prose(20)}") for k in range(400)]
    odd = [(1000, "what a s t u p i d 1d10t " + prose(9)), (1001, prose(40)), (1002, None), (1003, ""), (None, prose(3)), (1004, prose(40_000))]
    docs = spark.createDataFrame([(*x, "c") for x in rows + odd + odd[:1]], "doc_id long, text string, held_out string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(9999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = toxicity.scored(docs, model).collect()
    got = {x.doc_id: x for x in scored}
    assert len(scored) == len(rows) + len(odd) + 1
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and got[1004].predicted == 0
    assert got[1002].score == got[1003].score and got[None].held_out is False
    assert {x.score for x in toxicity.scored(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    one = {x.score for x in toxicity.scored(docs, toxicity.fit(docs, labels.where("toxic = 0"))).collect()}
    assert len(one) == 1 and one.pop() < 0.3
    assert toxicity.scored(docs.limit(0), model).count() == 0
    assert "stupid idiot" in {x.doc_id: x.text for x in toxicity.restored(docs, model.language).collect()}[1000]


# --- op13 ---


def plain_negatives(rows, every=50):
    rows = [(i, tuple(int(np.floor(256 * float(v))) for v in x), label) for i, x, label in rows if i is not None and label is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    rows = sorted(set(rows))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for i, x, label in rows:
        if i % every:
            continue
        same = sorted((-dot(x, y), j) for j, y, m in rows if m == label and j != i)[:5]
        other = sorted((-dot(x, y), j) for j, y, m in rows if m != label)
        for p, j in same:
            kept = [(-n, k) for n, k in other if -50 * p <= -100 * n <= -95 * p][:3]
            out += [(i, j, rank, k, -p, n) for rank, (n, k) in enumerate(kept, 1)]
    return sorted(out)


@pytest.mark.parametrize("clustered", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, clustered):
    for name, value in (("ANCHORS_A_CELL", 4), ("BLOCK_ANCHORS", 3), ("BLOCK_ROWS", 40), ("PROBE", 12)):
        monkeypatch.setattr(negatives, name, value)
    r = np.random.default_rng(13)
    centres = r.normal(size=(6, 8)) * 3
    vectors = [(centres[k % 6] if clustered else 0) + r.normal(size=8) * 0.4 for k in range(400)]
    rows = [(k, [float(np.float32(v)) for v in x], k % 5) for k, x in enumerate(vectors)]
    rows += [(1000 + k, rows[50][1], rows[50][2] if k % 2 else 1) for k in range(60)]  # copies
    rows += [(2000, None, 1), (2050, [1.0, None], 1), (2100, [float("nan")], 1), (2150, [float("inf")], 1), (2200, [1.0], None), (None, [1.0], 1), (2250, [], 1), (2300, [0.5, 0.25], 3), rows[100], rows[100]]
    df = spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, embedding array<float>, label int, anchor string")
    got = sorted(tuple(x) for x in negatives.hard_negatives(negatives.usable(df)).collect())
    assert got == plain_negatives(rows) and len(got) > 50


def test_bounds_exclude_rows_in_clusters():
    r = np.random.default_rng(1)
    centres = r.normal(size=(8, 16)) * 2000
    x = np.floor(np.repeat(centres, 50, 0) + r.normal(size=(400, 16)) * 20)
    p = negatives.Pivots(x[::50], float((x * x).sum(1).max()))
    d, rows = p.of_anchors(x[:1]), p.of_rows(x)
    exact = x[:1] @ x.T
    r0 = p.reach(x[:1], np.sort(exact[0])[-6:-5])
    meets = ((rows >= d - r0[:, None] - p.slack) & (rows <= d + r0[:, None] + p.slack)).all(1)
    assert set(np.argsort(-exact[0])[:6]) <= set(np.flatnonzero(meets))
    assert meets.mean() < 0.3
    assert np.allclose(np.sqrt((x[0] @ x[0]) + p.norm2 - 2 * (x[0] @ p.x.T)), d[0])


def test_hard_negatives_defined_cases(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(negatives.usable(empty)).count() == 0
    lone = spark.createDataFrame([(0, [1.0], 1), (1, [0.9], 2)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(negatives.usable(lone)).count() == 0
    big = spark.createDataFrame([(0, [1e30], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="too large"):
        negatives.usable(big).collect()


def test_hard_negatives_equal_sql(spark, sf_dir):
    assert assert_same(negatives.op13_hard_negatives(spark, sf_dir), connection(sf_dir), negatives.ORACLES["op13_hard_negatives"]) > 0


# --- what earlier operators lacked ---


def test_cut_off_boxes_are_value_errors():
    import struct

    from cuegrid.llm import op4_media

    box = lambda kind, body=b"": struct.pack(">I4s", 8 + len(body), kind) + body
    inside = lambda x: box(b"moov", box(b"trak", box(b"mdia", x if x[4:8] in (b"mdhd", b"hdlr") else box(b"minf", box(b"stbl", x)))))
    for kind, most in ((b"mdhd", 20), (b"hdlr", 12), (b"stsd", 16), (b"stsz", 12), (b"stco", 8), (b"stsc", 8)):
        for n in range(most):
            with pytest.raises(ValueError):
                op4_media.inspect(inside(box(kind, b"\0" * n)))
    with pytest.raises(ValueError):
        op4_media.inspect(inside(box(b"stsz", struct.pack(">III", 0, 0, 9))))


def test_long_texts_enter_the_start_of_the_states(spark, monkeypatch):
    """A corpus of long texts alone starts from excerpts of them, not from the random state."""
    from cuegrid.llm import hmm, op5_lmscore

    monkeypatch.setattr(op5_lmscore, "START_CHARS", 2000)
    monkeypatch.setattr(op5_lmscore, "START_ROUNDS", 1)
    seen, expected = [], hmm.expected
    monkeypatch.setattr(hmm, "expected", lambda m, symbols, bounds, into: seen.append(np.diff(bounds)) or expected(m, symbols, bounds, into))
    r = random.Random(1)
    docs = spark.createDataFrame([(k, " ".join(r.choice("the of and to in word".split()) for _ in range(3000))) for k in range(8)], "doc_id long, text string")
    assert op5_lmscore.score(docs).count() == 8
    # Excerpts of 2000 characters have about 600 of the words.
    assert seen and 0 < max(n.max() for n in seen) < 800


def test_items_have_an_edit_from_thirteen_characters_on(spark):
    from cuegrid.llm import op9_decontaminate as op9

    docs = spark.createDataFrame([(1, "say abcdefghijxlm now"), (2, "say abcdefghijklm now"), (3, "say abcdefghijxl now"), (4, "xabcdefghijkl"), (5, "abcdefghijkl")], "doc_id long, text string")
    thirteen, twelve = (spark.createDataFrame([(7, t, "x")], "item_id long, text string, item string") for t in ("ABCDEFGHIJKLM", "abcdefghijkl"))
    assert sorted((r.doc_id, r.distance) for r in op9.leaks(docs, thirteen).collect()) == [(1, 1), (2, 0), (4, 1), (5, 1)]
    assert [(r.doc_id, r.distance) for r in op9.leaks(docs, twelve).collect()] == [(5, 0)]
