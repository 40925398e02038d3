"""WARC, decontamination, language model, n-gram join and pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logtide.llm import decontaminate, gru_lm, ngram_join, warc

rng = random.Random(11)


# ---- WARC


def pages(spark):
    big = "".join(f"<p>{i} \r\n\r\nWARC/1.1\r\n é🦄</p>" for i in range(3000))
    html = [None, "", "small", "small", "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "y" * 1000, big, big, "z\r\n\r\n" * 400]
    rows = [(i, None if i == 3 else f"http://h/{i}\r\nX: y", h, "clash") for i, h in enumerate(html)]
    return spark.createDataFrame([*rows, rows[9], rows[6], (None, "u", "small", "")], "page_id long, url string, html string, record_type string")


def test_warc_round_trip(spark, tmp_path):
    df = pages(spark)
    path = f"file://{tmp_path}/w"
    warc.write(df, path, segment_bytes=500, chunk_bytes=64)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(spark, path).collect())
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]
    top = {}
    for i, p in rows:
        top[p] = max(top.get(p, -1), -1 if i is None else i)
    expected = []
    for i, p in rows:
        again = len(p) >= 1000 and i != top[p]
        expected.append((str(i), len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", top[p] if again else None))
    assert got == sorted(expected)


def test_warc_empty_and_plain(spark):
    assert warc.round_trip(pages(spark)).count() == pages(spark).count()
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def payload_lengths(payloads):
    """Lengths read back from the records of these payloads at the default sizes, through the bytes of one file."""
    import pyarrow as pa

    out = b""
    for i, p in enumerate(payloads):
        for r in warc.records(str(i), "http://h/", p, hashlib.sha1(p).hexdigest(), None, warc.SEGMENT_BYTES, warc.CHUNK_BYTES):
            out += r + warc.END.encode()
    lines = out.split(warc.END.encode())
    assert lines.pop() == b""
    rows = [r for b in warc._parse(iter([pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["value"])])) for r in b.to_pylist()]
    groups = {}
    for r in rows:
        groups.setdefault(r["origin"], []).append(r)
    got = {}
    for rs in groups.values():
        rs.sort(key=lambda r: r["segment"])
        segs = pa.array([[{k: r[k] for k in ("segment", "total", "block")} for r in rs]])
        digest = next(r["digest"] for r in rs if r["digest"])
        page = next(r["page_id"] for r in rs if r["page_id"])
        batch = pa.RecordBatch.from_arrays([pa.array([page]), pa.array([digest]), pa.array(["response"]), pa.array([None], pa.string()), pa.array([1], pa.int32()), segs], list("abcdef"))
        got[int(page)] = next(warc._join(iter([batch])))["payload_bytes"][0].as_py()
    return [got[i] for i in range(len(payloads))]


def test_warc_lengths_about_the_segment_size():
    for unit in (b"x", "é🦄".encode(), b"a\r\n", b"\n", b"\r\n\r\n"):
        payloads = [(unit * (n // len(unit) + 1))[:n] for n in range(16_200, 16_500)]
        assert payload_lengths(payloads) == [len(p) for p in payloads]
    payloads = [("é" * n).encode() for n in range(8_100, 8_250)] + [b"y" * n for n in (0, 1, 32_650, 32_700, 1_000_000)]
    assert payload_lengths(payloads) == [len(p) for p in payloads]


def test_joins_by_count_agree(spark):
    from logtide.llm import common

    rows = spark.createDataFrame([(f"k{i % 7 if i % 3 else 0}", i) for i in range(100)] + [(None, 1), ("none", 2)], "k string, v int")
    groups = rows.where("k <> 'none'").groupBy("k").agg(F.max("v").alias("top"))
    expected = sorted(map(str, common.join_by_count(rows, groups, "k").collect()))
    assert len(expected) == 102
    for few, large in ((3, 1000), (3, 20), (1, 2)):
        assert sorted(map(str, common.join_by_count(rows, groups, "k", few, large).collect())) == expected


def test_warc_checks():
    with pytest.raises(ValueError):
        list(warc._blocks(iter([b"WARC/1.1\r\nContent-Length: 5", b"1234567"])))
    with pytest.raises(ValueError):
        list(warc._blocks(iter([b"WARC/1.1\r\nContent-Length: 5", b"123"])))
    for bad in (b"5\r\nab\r\n", b"zz", b"2\r\nabX"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    for n in (0, 1, 63, 64, 65, 5000):
        assert warc.unchunked(warc.chunked(b"x" * n, 64)) == b"x" * n


def test_missing_segments_are_found():
    import pyarrow as pa

    block = pa.array([[{"segment": 1, "total": None, "block": b"a"}, {"segment": 3, "total": 2, "block": b"b"}]])
    batch = pa.RecordBatch.from_arrays([pa.array(["1"]), pa.array(["d"]), pa.array(["response"]), pa.array([None], pa.string()), pa.array([1], pa.int32()), block], list("abcdef"))
    with pytest.raises(ValueError, match="missing"):
        list(warc._join(iter([batch])))


# ---- decontamination


def sentence(n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edited(ws, edits):
    ws = list(ws)
    for _ in range(edits):
        at, kind = rng.randrange(len(ws)), rng.random()
        if kind < 0.33:
            ws[at] = f"q{rng.randrange(99)}"
        elif kind < 0.66:
            ws.insert(at, f"q{rng.randrange(99)}")
        else:
            del ws[at]
    return ws


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_nearest_is_exact():
    for _ in range(100):
        item, text = [rng.randrange(4) for _ in range(rng.randint(1, 8))], [rng.randrange(4) for _ in range(rng.randint(0, 20))]
        d, a, b = decontaminate.nearest(np.array(item), np.array(text, np.int64))
        assert d == plain_distance(item, text)
        assert d == plain_distance(item, text[a:b]) and d >= abs(len(item) - (b - a))


def test_recall_and_precision():
    items = [(i, " ".join(sentence(n))) for i, n in enumerate([5, 8, 14, 20, 31, 47, 65] * 4)]
    m = decontaminate.Matcher(items)
    hit = total = 0
    for _ in range(6):
        for k, text in items:
            ws = decontaminate.words(text)
            doc = sentence(rng.randrange(40)) + edited(ws, int(0.2 * len(ws))) + sentence(rng.randrange(40))
            near = plain_distance(ws, doc) <= int(0.2 * len(ws))
            got = {g[1]: g for g in m.find([" ".join(doc).upper()])}
            if near:
                total += 1
                hit += k in got
            for j, g in got.items():  # nothing is reported that is not near
                other = decontaminate.words(items[j][1])
                assert plain_distance(other, doc) == g[4] <= int(0.2 * len(other))
    assert total > 100 and hit / total >= 0.95


def test_hashing_finds_near_windows_and_leaves_others():
    """Recall at the farthest distance and share of candidates among windows of other text, of the hashing alone, in every length."""
    common = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 3) for i in range(400)]
    items = [(i, " ".join(rng.choices(common, weights, k=n))) for i, n in enumerate([10, 15, 20, 30, 45, 60] * 5)]
    m = decontaminate.Matcher(items)
    found = total = wrong = pairs = 0
    for x, item in enumerate(m.items):
        k = int(np.searchsorted(m.lengths, len(item)))
        same = sum(len(other) == len(item) for other in m.items)
        for _ in range(20):
            ws = edited(item.tolist(), int(0.2 * len(item)))
            window = np.array([m.other if isinstance(w, str) else w for w in ws + ["q"] * len(item)][: len(item)])
            got = {int(i) for _, some in m.candidates(window, np.array([0]), np.array([k])) for i in some}
            found, total = found + (x in got), total + 1
            window = np.array([m.vocabulary.get(w, m.other) for w in rng.choices(common, weights, k=len(item))])
            got = {int(i) for _, some in m.candidates(window, np.array([0]), np.array([k])) for i in some}
            wrong, pairs = wrong + len(got), pairs + same
    assert found / total >= 0.95 and wrong / pairs <= 0.1, (found / total, wrong / pairs)


def test_blocks_cover_all_items(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(sentence(5 + i % 7))) for i in range(50)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CELLS", 100)
    blocks = list(decontaminate._blocks(bench))
    assert len(blocks) > 5 and sorted(i for b in blocks for i, _ in b) == list(range(50))
    docs = spark.createDataFrame([(r["item_id"], "x " + r["text"] + " y") for r in bench.collect()], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()}
    assert {(i, i) for i in range(50)} <= got
    assert decontaminate.clean(docs, bench).count() == 0


def test_decontaminated_rows(spark):
    item = " ".join(sentence(30))
    docs = spark.createDataFrame(
        [(1, f"before {item} after", "c"), (2, None, "c"), (3, "", "c"), (4, "nothing of that", "c"), (4, item, "c"), (5, "the " * 20_000 + item, "c"), (6, " ".join(item.split()[1:]), "c"), (None, item, "c")],
        "doc_id long, text string, item_id string",
    )
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 1), (10, "unheard of words only", 1), (None, item, 1)], "item_id long, text string, doc_id int")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["edits"]) for r in decontaminate.matches(docs, bench).collect())
    assert got == [(0, 7, 0), (1, 7, 0), (4, 7, 0), (5, 7, 0), (6, 7, 1)]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 == decontaminate.matches(docs, bench.limit(0)).count()
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


# ---- language model


def test_gradients():
    net = gru_lm.Network.fresh(np.array([5, 4, 3, 2, 2, 1, 1.0]), hidden=3, sizes=((1, 1), (2, 3), (4, 99)))
    net.w = {k: v.astype(np.float64) * (1 if k in ("bo", "bc") else 3) for k, v in net.w.items()}
    r = np.random.default_rng(0)
    x, y, mask, fresh, h = r.integers(0, 7, (5, 2)), r.integers(0, 7, (5, 2)), np.ones((5, 2), bool), np.zeros((5, 2)), r.standard_normal((2, 3))
    mask[4, 1], fresh[2, 1] = False, 1
    _, grads, _ = net.gradients(x, y, mask, fresh, h)
    for k in net.w:
        for _ in range(5):
            i = tuple(r.integers(0, s) for s in net.w[k].shape)
            was, sides = net.w[k][i], []
            for e in (1e-4, -1e-4):
                net.w[k][i] = was + e
                sides.append(net.gradients(x, y, mask, fresh, h)[0])
            net.w[k][i] = was
            assert abs((sides[0] - sides[1]) / 2e-4 - grads[k][i]) < 1e-3


def test_probabilities_sum_to_one_and_state_is_carried():
    net = gru_lm.Network.fresh(np.array([1.0, 5, 4, 3, 2]), hidden=4, sizes=((3, 99),))
    hidden = np.random.default_rng(2).standard_normal((1, 4)).astype(np.float32)
    every = [net.output(hidden, np.array([k]))[0][0] for k in range(6)]
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-5)
    docs = [np.array([1, 2, 3, 4, 1, 2] * 20), np.array([2]), np.array([4, 4, 1])]
    one = gru_lm.log_probabilities(net, docs, 1, width=1, window=7)
    assert np.allclose(one, gru_lm.log_probabilities(net, docs, 1, width=8, window=64), atol=1e-4)
    # one document, step by step without windows
    states, _, _ = net.states(np.concatenate([[1], docs[0][:-1]])[:, None], np.eye(120, dtype=np.float32)[:, :1], np.zeros((1, 4), np.float32))
    assert net.output(states[:, 0], docs[0])[0].sum() == pytest.approx(one[0], abs=1e-3)


def test_one_long_text_among_short_ones_takes_little_memory():
    import tracemalloc

    net = gru_lm.Network.fresh(np.ones(200))
    docs = [np.ones(300_000, np.int64), *[np.array([1, 2, 3])] * 511]
    tracemalloc.start()
    got = gru_lm.log_probabilities(net, docs, 1)
    assert tracemalloc.get_traced_memory()[1] < 60_000_000 and got[1] == pytest.approx(got[511], abs=1e-4) and got[0] < got[1] < 0
    tracemalloc.stop()


def test_frequent_tokens_fill_the_room(spark):
    rows = [(f"t{i}".encode(), 1 + (i < 900) + (i < 300) * 40 + (i < 20) * i * 100) for i in range(4000)]
    counts = spark.createDataFrame(rows, "token binary, c long")
    for most in (0, 5, 100, 310, 900, 2500, 10_000):
        got = gru_lm.frequent(counts, most)
        assert min(most, 4000) * 0.9 - 3 <= len(got) <= most, most
        least = min((c for _, c in got), default=99_999)
        assert all((t, c) in set(got) for t, c in rows if c > least)


def test_scores(spark):
    pattern = "alpha beta gamma delta epsilon zeta"
    rows = [(i, " ".join([pattern] * 12) if i % 3 else f"Alpha rare{i} beta", "c") for i in range(300)]
    rows += [(300, None, "c"), (301, "", "c"), (None, "alpha", "c"), (300, "alpha\x0bbeta", "c"), (302, "beta " * 20_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = gru_lm.score(df).collect()
    assert len(out) == len(rows)
    count = Counter()
    key = lambda i: "" if i is None else str(i)
    for i, t, _ in rows:
        if zlib.crc32(key(i).encode()) % 10:
            count.update(gru_lm.tokens(t))
    n, v = sum(count.values()), len(count)
    by = {}
    for i, t, _ in rows:
        ts = gru_lm.tokens(t)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)
        by.setdefault(i, []).append((zlib.crc32(key(i).encode()) % 10 == 0, len(ts), sum(count[w] > 0 for w in ts), n, round(base, 4)))
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)))
        assert r["score"] < 0
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in by.items()}
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # better than the counts on texts not seen


def test_every_training_document_makes_gradient_steps(spark, monkeypatch):
    rounds = []
    real = gru_lm._train_round
    monkeypatch.setattr(gru_lm, "_train_round", lambda net, words, texts: rounds.append([r["text"] for r in texts.collect()]) or real(net, words, texts))
    gru_lm.fit(spark.createDataFrame([(i, f"word{i} alpha") for i in range(400)], "doc_id long, text string"))
    training = [f"word{i} alpha" for i in range(400) if zlib.crc32(str(i).encode()) % 10]
    assert sorted(t for texts in rounds for t in texts) == sorted(training)
    assert all(rounds) and len(rounds) == gru_lm.ROUNDS


def test_training_lanes_hold_every_token_with_its_state():
    net = gru_lm.Network.fresh(np.array([1.0, 5, 4, 3, 2]), hidden=4, sizes=((3, 99),))
    docs = [np.array([2, 3, 4, 1, 2, 3, 2, 2, 4, 1]), np.array([3, 1]), np.array([4, 2, 3, 3, 2, 1]), np.array([1])]
    inputs, targets, used, fresh, h = gru_lm.stream(net, docs, 1, 4, 3)
    assert targets.T[used.T].tolist() == np.concatenate(docs).tolist() and fresh.sum() == len(docs)
    whole = []
    for d in docs:
        states, _, _ = net.states(np.concatenate([[1], d[:-1]])[:, None], np.eye(len(d), dtype=np.float32)[:, :1], np.zeros((1, 4), np.float32))
        whole.append(states[:, 0])
    states, _, _ = net.states(inputs, fresh, h)
    assert np.allclose(states.transpose(1, 0, 2)[used.T], np.concatenate(whole), atol=1e-6)


def test_scores_without_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert gru_lm.score(df).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = gru_lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, pytest.approx(0))


# ---- n-gram join


def brute(rows):
    sets = [{tuple(ws[i : i + 3]) for i in range(len(ws) - 2)} or ({tuple(ws)} if ws else set()) for ws in ((t or "").encode().lower().split() for _, t in rows)]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 90 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((str(k), len(sets[i]), (min(ids) if ids else None) if sets[i] else k))
    return sorted(out, key=str)


def near_copies():
    rows, n = [], 0
    for size in (3, 12, 40, 120, 300):
        for _ in range(3):
            base = sentence(size, 3000)
            for _ in range(6):
                ws = list(base)
                for _ in range(rng.randrange(1 + size // 40)):
                    ws[rng.randrange(len(ws))] = f"n{rng.randrange(9999)}"
                rows.append((n, " ".join(ws)))
                n += 1
    shared = " ".join(sentence(60))
    rows += [(n + i, shared + " " + " ".join(sentence(4, 9000))) for i in range(12)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two WORDS"), (905, "one"), (906, "one"), (None, "one"), (907, rows[0][1]), (907, rows[0][1]), (908, "the " * 20_000)]
    return rows


def test_components(spark):
    rows = near_copies()
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, n_shingles string")
    got = [(str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.components(df).collect()]
    assert sorted(got, key=str) == brute(rows)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    found = brute(rows)
    named = {c for _, n, c in found if n}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([*named, *(int(k) for k, n, _ in found if not n)], key=str)


def test_one_row_of_each_component_where_ids_repeat(spark, monkeypatch):
    a, b, c = (" ".join(sentence(50, 5000)) for _ in range(3))
    rows = [(5, a), (5, a), (5, b), (3, b + " more"), (3, c), (7, c), (None, c), (None, "alone here by itself"), (8, None), (8, None), (9, "")]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, key int")
    expected = sorted([(5, a), (3, b + " more"), (3, c), (None, "alone here by itself"), (8, None), (8, None), (9, "")], key=str)
    for wanted in (300_000, -1):
        monkeypatch.setattr(ngram_join, "BROADCAST_WANTED", wanted)
        kept = ngram_join.one_of_each(df, percent=90)
        assert kept.columns == df.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == expected


def test_components_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 4)
    monkeypatch.setattr(ngram_join, "FOLLOWERS_PER_KEY", 2)
    monkeypatch.setattr(ngram_join, "BROADCAST_WANTED", -1)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.components(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_links_inside_a_group_without_its_head(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_sketch", lambda texts, *_: np.zeros(1 << ngram_join.CELL_BITS, np.int32))
    for k in range(10_000):  # equal first shingles, and least digest for the one that links with neither
        base = [f"w{k}x{i}" for i in range(42)]
        texts = [" ".join(ws) for ws in (base[:14] + ["p"] + base[15:28] + ["q"] + base[29:], base, base[:-1] + ["r"])]
        sets = [ngram_join.shingles(t) for t in texts]
        sigs = [ngram_join._signature(s) for s in sets]
        if len({s[:5].tobytes() for s in sets}) == 1 and sigs[0] == min(sigs):
            break
    assert [ngram_join.linked(sets[i], sets[j]) for i, j in ((0, 1), (0, 2), (1, 2))] == [False, False, True]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.components(df).collect()} == {0: 0, 1: 1, 2: 1}


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.components(df).count() == 0 == ngram_join.one_of_each(df).count()


def test_connected_components(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40) if i != 20] + [("500", "001"), ("600", "600"), ("700", "701")]
    df = spark.createDataFrame([(a.encode(), b.encode()) for a, b in edges], "a binary, b binary")
    got = {bytes(r["node"]).decode(): bytes(r["comp"]).decode() for r in ngram_join.components_of(df).collect()}
    assert {got[f"{i:03d}"] for i in range(21)} == {"000"} and {got[f"{i:03d}"] for i in range(21, 41)} == {"021"} and got["500"] == "000" and got["701"] == "700"


def test_near_copies_of_the_pipeline_stage(spark):
    rows = []
    for i in range(8):
        ws = sentence(100, 3000)
        rows += [(3 * i, " ".join(ws)), (3 * i + 1, " ".join(ws[:50] + [f"new{i}"] + ws[51:])), (3 * i + 2, " ".join(ws[:20] + ["x"] + ws[21:80] + ["z"] + ws[81:]))]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert kept == sorted(set(comp)) and len(kept) < len(ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())


# ---- pipeline


def test_pipeline(spark, tmp_path):
    good = [" ".join(sentence(60, 5000)) for _ in range(12)]
    item = " ".join(sentence(30))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [
        (20, good[0], "en", "s", 1), (21, "too short", "en", "s", 1), (22, "*** " * 50, "en", "s", 1), (23, good[1] + " " + item + " " + good[2], "en", "s", 1),
        (24, " ".join(sentence(60, 5000)) + " token=abcdefghijklmnop", None, None, 1), (25, None, "en", "s", None),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert sorted(out) == [*range(12), 24]
    assert out[24]["text"].endswith(" [SECRET]") and out[24]["n_chars"] == len(out[24]["text"])
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in out.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "SentencePiece encoding"]


def test_release_deletes_written_tables(spark):
    import os

    from logtide.llm import common

    path = common.table(spark.range(3), "x").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    assert common.release(spark) > 0 and not os.path.exists(path)
