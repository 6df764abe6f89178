import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.llm import boilerplate, history_dedup, mixing, near_dup, repeated_lines, stuffing, text_quality, tokens

WORD = re.compile(r"[^\W_]+")
VOCAB = [a + b for a in "bcdfglmnprst" for b in ("ala", "ero", "imu", "ota", "une", "ays")]


def triples(text):
    w = WORD.findall((text or "").lower())
    return set(zip(w, w[1:], w[2:], strict=False)) if len(set(w)) >= 20 else None


def similarity(a, b):
    a, b = triples(a), triples(b)
    return 0.0 if a is None or b is None else len(a & b) / len(a | b)


def prose(rng, sentences):
    return " ".join(" ".join(rng.choices(VOCAB, k=rng.randint(6, 12))).capitalize() + "." for _ in range(sentences))


def edited(rng, text, share):
    return " ".join(rng.choice(VOCAB) if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def texts():
    """Families of near copies, exact copies, unrelated texts, one line shared by many, and odd rows."""
    rng = random.Random(11)
    rows, shared = {}, " ".join(VOCAB[:9]).capitalize() + ". "
    for family in range(12):
        base = prose(rng, 8)
        for k in range(4):
            rows[len(rows)] = edited(rng, base, 0.03 * k)
        rows[len(rows)] = base.upper().replace(".", " !")
    for _ in range(60):
        rows[len(rows)] = shared + prose(rng, 5)
    rows |= {len(rows) + i: t for i, t in enumerate([None, "", "   ", "few words only", "word " * 500, "日本語の文章。" * 40, prose(rng, 2000)])}
    return rows


def pairs_of(texts):
    keys = sorted(texts)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if similarity(texts[a], texts[b]) >= 0.5}


def test_p4_equals_brute_force(spark, texts):
    rows = [(k, v, "clash", 1, 2) for k, v in texts.items()] + [(3, texts[3], "clash", 1, 2)]
    df = spark.createDataFrame(rows, "id long, text string, class string, signature int, class_id int")
    got = {(r.id_a, r.id_b) for r in near_dup.similar_pairs(df).collect()}
    assert got == pairs_of(texts)
    groups = {r.id: r.group_id for r in near_dup.similar_groups(df).collect()}
    assert all(groups[a] == groups[b] for a, b in got) and len(set(groups.values())) < len(groups)
    empty = spark.createDataFrame([], "id long, text string")
    assert near_dup.similar_pairs(empty).count() == 0 and near_dup.similar_groups(empty).count() == 0


def test_p4_many_copies_are_a_star(spark):
    text = prose(random.Random(2), 6)
    other = edited(random.Random(3), text, 0.03)
    df = spark.createDataFrame([(i, text) for i in range(100)] + [(500, other)], "id long, text string")
    got = {(r.id_a, r.id_b) for r in near_dup.similar_pairs(df).collect()}
    assert got == {(0, i) for i in range(1, 100)} | {(0, 500)}


def test_p4_allocation_is_cheapest():
    import itertools

    import numpy as np

    rng = np.random.RandomState(0)
    both, one = rng.randint(0, 9, (30, 4)).astype(float), rng.randint(5, 40, (30, 4)).astype(float)
    for need in (1, 3, 5, 8):
        e = near_dup.allocate(both, one, need)
        for k in range(30):
            cost = {-1: [0] * 4, 0: both[k], 1: one[k]}
            best = min(sum(cost[x][i] for i, x in enumerate(c)) for c in itertools.product((-1, 0, 1), repeat=4) if sum(x + 1 for x in c) >= need)
            assert sum(e[k] + 1) >= need and sum(cost[int(x)][i] for i, x in enumerate(e[k])) == best


@pytest.mark.parametrize(("shared", "gains"), [(0, 39), (9, 39), (12, 36), (16, 32)])
def test_p4_shared_symbols_bring_few_candidates(shared, gains):
    """20,000 unrelated signatures, some symbols of which all records share: candidates a record by the operator's own probes and exact counts."""
    import numpy as np

    rng = np.random.RandomState(shared)
    sig = rng.randint(-(2**31), 2**31, (20_000, near_dup.SYMBOLS), np.int64).astype(np.int32)
    sig[:, :shared] = np.arange(shared)
    cells = np.zeros(near_dup.CELLS, np.int64)
    for keys in near_dup.partition_keys(sig):
        np.add.at(cells, (keys >> np.uint64(44)).astype(np.int64).ravel(), 1)
    keys, probed, _, got = near_dup.probes(sig, cells)
    counts = dict(zip(*(x.tolist() for x in np.unique(keys, return_counts=True)), strict=True))
    met = sum(counts[k] - 1 for k in keys[probed].tolist())
    assert met < 200 * len(sig) and np.median(got) == gains


def test_p4_recall_under_a_template(spark, monkeypatch):
    """All texts share a template of about a quarter of their words, so that shared symbols are given up and keys are spread."""
    monkeypatch.setattr(near_dup, "BUDGET", 10)
    monkeypatch.setattr(near_dup, "SPREAD", 50)
    rng = random.Random(41)
    vocab = [a + b for a in VOCAB for b in VOCAB]
    template, rows = " ".join(rng.choices(vocab, k=50)), {}
    for i in range(150):
        own = rng.choices(vocab, k=90)
        rows[i] = template + " " + " ".join(own)
        if i < 60:
            rows[1000 + i] = template + " " + " ".join(rng.choice(vocab) if rng.random() < 0.08 else w for w in own)
    want = pairs_of(rows)
    got = {(r.id_a, r.id_b) for r in near_dup.similar_pairs(spark.createDataFrame(list(rows.items()), "id long, text string")).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 60


@pytest.fixture
def sent():
    """Sends the package's code and settings to the workers, which otherwise import their own."""
    from pyspark import cloudpickle

    import lexmill

    cloudpickle.register_pickle_by_value(lexmill)
    yield
    cloudpickle.unregister_pickle_by_value(lexmill)


def test_p4_templated_pairs_are_all_found(spark, monkeypatch, sent):
    """A template of two fifths of each text: pairs just above 0.5 agree in few symbols of their own, and however many of the others are given up, all are found."""
    monkeypatch.setattr(near_dup, "BUDGET", 0)
    monkeypatch.setattr(near_dup, "LEAST_GAINS", 6)
    monkeypatch.setattr(near_dup, "SPREAD", 50)
    monkeypatch.setattr(near_dup, "PASS_KEYS", 4000, raising=False)
    rng = random.Random(43)
    vocab = [a + b for a in VOCAB for b in VOCAB]
    template, rows = " ".join(rng.choices(vocab, k=54)), {}
    for i in range(200):
        own = rng.choices(vocab, k=66)
        rows[i] = template + " " + " ".join(own)
        rows[1000 + i] = template + " " + " ".join(own[: 31 + i % 3] + rng.choices(vocab, k=35 - i % 3))
    want = pairs_of(rows)
    got = {(r.id_a, r.id_b) for r in near_dup.similar_pairs(spark.createDataFrame(list(rows.items()), "id long, text string")).collect()}
    assert got == want and len(want) >= 100


def test_p4_rare_pairs_equal_brute_force(spark, texts, monkeypatch, sent):
    """The join on the rarest triples alone finds all pairs, with spread keys and in several passes."""
    from lexmill.llm.common import Scratch, verified_pairs

    monkeypatch.setattr(near_dup, "SPREAD", 5)
    monkeypatch.setattr(near_dup, "PASS_KEYS", 2000)
    monkeypatch.setattr("lexmill.llm.common.PASS_PAIRS", 20)
    df = spark.createDataFrame([(k, t) for k, t in texts.items() if triples(t)], "id long, text string")
    hold = Scratch()
    pairs = near_dup.rare_pairs(hold(df.select("id"), "ids"), df, 0.5, hold).distinct()
    assert {(r.a, r.b) for r in verified_pairs(hold(pairs, "pairs"), df, 0.5, hold).collect()} == pairs_of(texts)
    hold.discard()


def test_p4_pairs_are_judged_where_they_meet():
    """Of records that share a key only those that agree in enough symbols come out, however the rows fall into batches."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.RandomState(5)
    sig = rng.randint(0, 2**32, (60, near_dup.SYMBOLS), np.uint64).astype(np.uint32)
    sig[30:, : near_dup.LEAST_EQUAL] = sig[:30, : near_dup.LEAST_EQUAL]
    key, asks = rng.randint(0, 3, (60, 2)).astype(np.uint64), rng.rand(60, 2) < 0.5
    agree = (sig[:, None].astype(np.uint8) == sig[None].astype(np.uint8)).sum(2) >= near_dup.LEAST_EQUAL
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if agree[i, j] and any(key[i, x] == key[j, y] and (asks[i, x] or asks[j, y]) for x in (0, 1) for y in (0, 1))}
    batch = near_dup._key_rows(np.arange(60), near_dup._bytes(sig), np.repeat(np.arange(60), 2), key.ravel(), np.ones(120, bool), asks.ravel(), np.full(120, 9))
    table = pa.Table.from_batches([batch]).sort_by([("key", "ascending"), ("role", "ascending")]).combine_chunks()
    for size in (1, 7, 1000):
        got = [p for b in near_dup._meet(iter(table.to_batches(size))) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert set(got) == want and len(want) > 3 and len(got) < 3 * len(want)


def test_p4_leaves_no_shuffle_files(spark, texts):
    def files():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    df, before = spark.createDataFrame(list(texts.items()), "id long, text string"), files()
    near_dup.similar_classes(df)
    assert files() <= before


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("http://A.example./x/", " https://a.example:443/x#f ", True), ("https://a.example/x?b=2&a=1&utm_z=3&SK=1", "https://a.example/x?a=1&b=2", True), ("https://a.example/%7Eu/s%65g", "https://a.example/~u/seg", True),
        ("https://a.example", "https://a.example/", True), ("https://a.example/x?a=1", "https://a.example/x?a=2", False), ("https://a.example/X", "https://a.example/x", False), ("https://a.example/a%2Fb", "https://a.example/a/b", False),
        ("https://a.example:8080/", "https://a.example/", False), ("https://www.a.example/", "https://a.example/", False), ("https://a.example/?feed=1", "https://a.example/", False),
    ],
)
def test_p1_addresses(a, b, same):
    assert (history_dedup.page_address(a) == history_dedup.page_address(b)) is same


def test_p1_odd_addresses():
    assert history_dedup.page_address(None) is None and history_dedup.page_address("  ") is None
    assert history_dedup.page_address("https://[bad") == "https://[bad" and history_dedup.page_address("not a url") == "not a url"


def greedy(items, texts):
    accepted, cases = [], {}
    for _, item, url, doc in sorted(items):
        page = history_dedup.page_address(url)
        hit = next((i for i, p, d in accepted if (page is not None and p == page) or (doc is not None and d is not None and similarity(texts.get(doc), texts.get(d)) >= 0.5)), None)
        if hit is None:
            accepted.append((item, page, doc))
        else:
            cases[item] = hit
    return cases


@pytest.mark.parametrize("steps", [1, 3])
def test_p1_equals_greedy_order(spark, texts, steps):
    rng = random.Random(4)
    docs = [k for k in texts]
    runs = [(f"r{i}", i) for i in range(6)]
    items, brute = [], []
    for i in range(220):
        run = rng.randrange(7)
        url = None if i % 17 == 0 else f"https://h.example/p{rng.randrange(120)}" + rng.choice(["", "/", "?utm_a=1", "#x"])
        if i % 3 == 0:
            url = "https://h.example/hot"  # a third of all items name one page
        doc = rng.choice([None, *docs])
        items.append((i, f"r{run}", i, url, doc, "x"))
        brute.append(((run if run < 6 else 99, i), i, url, doc))
    items.append(items[5])
    df = spark.createDataFrame(items, "id long, job_id string, position long, canonical_url string, document_id long, head string")
    run_df = spark.createDataFrame(runs, "job_id string, batch_no long")
    text_df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [(3, texts[3], 1)], "id long, text string, page int")
    got = {r.item_id: r.accepted_id for r in history_dedup.repeated_items(df, run_df, text_df, steps).collect()}
    assert got == greedy(brute, texts)


def test_p1_history_is_bucketed_and_empty_runs_pass(spark, texts):
    history = history_dedup.AcceptedHistory(spark, buckets=4)
    text_df = spark.createDataFrame(list(texts.items()), "id long, text string")
    shape = "item_id long, ord long, document_id long, url string"
    assert history.admit(spark.createDataFrame([], shape), text_df).count() == 0
    first = spark.createDataFrame([(i, i, i, f"https://a.example/{i}") for i in range(10)], shape)
    history.admit(first, text_df)
    cases = history.admit(spark.createDataFrame([(100, 100, 4, "https://b.example/"), (101, 101, None, "http://a.example/5/"), (102, 102, None, None)], shape), text_df)
    assert {r.item_id for r in cases.collect()} == {100, 101}
    history.close()


def shuffled_scans(df, table):
    """Nodes above each scan of a table of the history, up to the join it feeds."""
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = text.splitlines()
    out = []
    for i, line in enumerate(lines):
        if "Scan parquet" in line and table in line:
            depth, above = line.index("Scan parquet"), []
            for up in reversed(lines[:i]):
                at = len(up) - len(up.lstrip(" :+-*"))
                if at < depth:
                    depth = at
                    above.append(up.lstrip(" :+-*"))
                    if "Join" in up:
                        break
            out.append((line, above))
    return out


def test_p1_history_is_not_shuffled(spark, texts):
    """A new batch is shuffled to the buckets; of the history's tables none is, and its texts aren't read again."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        history = history_dedup.AcceptedHistory(spark, buckets=4)
        shape = "item_id long, ord long, document_id long, url string"
        text_df = spark.createDataFrame(list(texts.items()), "id long, text string")
        history.admit(spark.createDataFrame([(i, i, i, f"https://a.example/{i}") for i in range(60)], shape), text_df)
        for table, kind in (("pages", "long"), ("keys", "long"), ("heads", "binary")):
            key = history.TABLES[table].split()[0]
            asked = spark.createDataFrame([], f"{key} {kind}").distinct()
            scans = shuffled_scans(history._ask(table, asked), f"_{table}")
            assert len(scans) == 1 and "Bucketed: true" in scans[0][0] and not any("Exchange" in x for x in scans[0][1]), scans
        # a later batch brings only its own texts; the stored sets answer for the history's
        near = edited(random.Random(1), texts[0], 0.03)
        cases = history.admit(spark.createDataFrame([(100, 100, 1000, None)], shape), spark.createDataFrame([(1000, near)], "id long, text string"))
        assert [tuple(r) for r in cases.collect()] == [(0, 100)]
        history.close()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_p1_history_is_durable(spark, texts, tmp_path, monkeypatch):
    shape = "item_id long, ord long, document_id long, url string"
    text_df = spark.createDataFrame(list(texts.items()), "id long, text string")
    path = str(tmp_path / "history")

    def batch(lo, hi):
        return spark.createDataFrame([(i, i, i, f"https://a.example/{i % 31}") for i in range(lo, hi)], shape)

    first = history_dedup.AcceptedHistory(spark, path, buckets=3)
    got = {r.item_id: r.accepted_id for r in first.admit(batch(0, 30), text_df).collect()}
    broken = history_dedup.AcceptedHistory(spark, path)
    append = broken._append
    monkeypatch.setattr(broken, "_append", lambda table, *a: append(table, *a) if table != "heads" else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        broken.admit(batch(30, 50), text_df)
    for table in first.TABLES:  # another session knows nothing of the tables
        spark.sql(f"DROP TABLE IF EXISTS {first.name}_{table}")
    again = history_dedup.AcceptedHistory(spark, path)
    assert again.started and again.state["uncommitted"] == [1]
    got |= {r.item_id: r.accepted_id for r in again.admit(batch(30, 50), text_df).collect()}
    again.compact(buckets=5)
    assert again.buckets == 5 and again.state["uncommitted"] == []
    got |= {r.item_id: r.accepted_id for r in again.admit(batch(50, len(texts)), text_df).collect()}
    assert got == greedy([(i, i, f"https://a.example/{i % 31}", i) for i in texts], texts)
    again.close()


def test_p1_crowds_of_near_copies(spark, monkeypatch):
    """120 edited copies of two texts, a third of them with addresses of earlier items: crowds are settled by their earliest text."""
    monkeypatch.setattr(history_dedup, "CROWD", 8)
    rng = random.Random(17)
    bases = [prose(rng, 9), prose(rng, 9)]
    rows = {i: edited(rng, bases[i % 2], rng.choice([0.0, 0.02, 0.05, 0.12])) for i in range(120)}
    url = {i: f"https://a.example/{i // 7}" if i % 3 == 0 else None for i in rows}
    shape = "item_id long, ord long, document_id long, url string"
    texts_ = spark.createDataFrame(list(rows.items()), "id long, text string")
    want = greedy([((0, i), i, url[i], i) for i in rows], rows)
    for parts in ([range(120)], [range(3), range(3, 120)]):
        history, got = history_dedup.AcceptedHistory(spark, buckets=3), {}
        for part in parts:
            got |= {r.item_id: r.accepted_id for r in history.admit(spark.createDataFrame([(i, i, i, url[i]) for i in part], shape), texts_).collect()}
        assert got == want
        history.close()


def test_p1_recall_on_evenly_edited_texts(spark):
    """Copies with evenly spaced substitutions, at a similarity of about 0.6, through the operator; at least 95 of 100 must be found at each length."""
    rng = random.Random(31)
    vocab = [a + b for a in VOCAB for b in VOCAB]
    rows, pairs = {}, {}
    for words, stops in ((24, False), (40, True), (60, False), (100, True), (200, False), (400, True)):
        want = len(pairs) + 60
        while len(pairs) < want:
            w = rng.choices(vocab, k=words)
            other = [rng.choice(vocab) if i % 12 == 6 else x for i, x in enumerate(w)]
            a, b = (" ".join(x + ("." if stops and i % 12 == 11 else "") for i, x in enumerate(t)) for t in (w, other))
            if similarity(a, b) >= 0.5:
                i = len(pairs)
                rows[i], rows[1000 + i], pairs[1000 + i] = a, b, i
    texts_ = spark.createDataFrame(list(rows.items()), "id long, text string")
    items = spark.createDataFrame([(i, i, i, None) for i in rows], "item_id long, ord long, document_id long, url string")
    history = history_dedup.AcceptedHistory(spark, buckets=3)
    got = {r.item_id: r.accepted_id for r in history.admit(items, texts_).collect()}
    history.close()
    for lo in range(0, 360, 60):
        assert sum(got.get(1000 + i) == i for i in range(lo, lo + 60)) >= 57


def test_p1_hot_paragraph(spark, monkeypatch):
    """A paragraph in nearly all texts, and copies whose other sentences are all changed."""
    monkeypatch.setattr(history_dedup, "HOT", 4)
    rng = random.Random(8)
    hot = prose(rng, 6)
    rows = {i: hot + " " + prose(rng, 30) for i in range(40)}
    rows |= {100 + i: hot + " " + edited(rng, rows[i][len(hot) + 1 :], 0.04) for i in range(20)}
    items = [((0, i), i, None, i) for i in rows]
    df = spark.createDataFrame([(i, i, i, None) for i in rows], "item_id long, ord long, document_id long, url string")
    got = {r.item_id: r.accepted_id for r in history_dedup.AcceptedHistory(spark, buckets=4).admit(df, spark.createDataFrame(list(rows.items()), "id long, text string")).collect()}
    assert got == greedy(items, rows) and len(got) == 20


def test_p1_no_common_paragraph(spark):
    """Copies with one word changed in each sentence: no paragraph is left as it was, within a run or between two."""
    ids, rng = history_dedup.WordIds(), random.Random(21)
    vocab = [w for w in (a + b for a in VOCAB for b in VOCAB[:6]) if (ids[w] >> 8) % 16]  # without words that cut a paragraph
    rows = {}
    for i in range(40):
        words = [rng.choices(vocab, k=12) for _ in range(6)]
        other = [[*w[:5], rng.choice(vocab), *w[6:]] for w in words]
        rows[i], rows[100 + i] = (" ".join(" ".join(w) + "." for w in x) for x in (words, other))
    texts = spark.createDataFrame(list(rows.items()), "id long, text string")
    shape = "item_id long, ord long, document_id long, url string"
    for parts in ([sorted(rows)], [range(40), range(100, 140)]):
        history, got = history_dedup.AcceptedHistory(spark, buckets=4), {}
        for part in parts:
            cases = history.admit(spark.createDataFrame([(i, i, i, None) for i in part], shape), texts)
            got |= {r.item_id: r.accepted_id for r in cases.collect()}
        assert got == greedy([((0, i), i, None, i) for i in rows], rows) and len(got) == 40


def test_p1_hot_paragraph_at_the_threshold(spark):
    """Pairs of similarity 0.5 to 0.54 that share hot paragraphs only: 16 bands lost about 1 in 100 of them."""
    ids, rng = history_dedup.WordIds(), random.Random(22)
    vocab = [w for w in (a + b for a in VOCAB for b in VOCAB) if (ids[w] >> 8) % 16]
    hot, rows, pairs = " ".join(vocab[:30]) + ". ", {}, {}
    while len(pairs) < 700:
        words = [rng.choices(vocab, k=9) for _ in range(8)]
        other = [[*w[:4], rng.choice(vocab), *w[5:]] if k else w[::-1] for k, w in enumerate(words)]
        a, b = (hot + " ".join(" ".join(w) + "." for w in x) for x in (words, other))
        if 0.5 <= similarity(a, b) < 0.54:
            i = len(pairs)
            rows[i], rows[1000 + i], pairs[1000 + i] = a, b, i
    texts = spark.createDataFrame(list(rows.items()), "id long, text string")
    items = spark.createDataFrame([(i, i, i, None) for i in rows], "item_id long, ord long, document_id long, url string")
    got = {r.item_id: r.accepted_id for r in history_dedup.AcceptedHistory(spark, buckets=4).admit(items, texts).collect()}
    assert got == pairs


def test_p2_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(90):
        host = rng.choice(["a.example", " A.Example. ", None, "b.example", "a.example"])
        lines = [rng.choice(["Share this story!", "share THIS story", "© 2024 Post", "-- 12 --", "", prose(rng, 1)]) for _ in range(rng.randint(0, 9))]
        rows.append((i, rng.choice([None, "\n".join(lines), "\r\n".join(lines)]) if i % 7 else "\n".join(lines), "https://u@c.example:8/x" if host is None else None, host, "clash"))
    rows += [rows[1], rows[2], (500, "Share this story!", None, None, "x"), (None, "Share this story!", None, "a.example", "x")]
    df = spark.createDataFrame(rows, "id long, content string, url string, source_host string, src string")

    def source(r):
        return ((r[3] or "").strip().lower().rstrip(".")) or ("c.example" if r[2] else None)

    docs = {r[0]: r for r in rows if r[0] is not None and source(r)}
    total, seen, places = {}, {}, {}
    for i, r in docs.items():
        total.setdefault(source(r), set()).add(i)
        for n, line in enumerate((r[1] or "").split("\n") if r[1] is not None else []):
            key = "".join(c for c in line.casefold() if c.isalpha())
            if key:
                seen.setdefault((source(r), key), set()).add(i)
                places.setdefault((source(r), key), set()).add((i, n))
    bad = {p for k, v in seen.items() if len(v) >= 5 and 10 * len(v) >= len(total[k[0]]) for p in places[k]}
    assert {(r.id, r.line_no) for r in repeated_lines.excessive_places(df).collect()} == bad and bad
    clean = {r.id: r.content for r in repeated_lines.without_excessive(df).collect()}
    for i, r in docs.items():
        assert clean[i] == (None if r[1] is None else "\n".join(x for n, x in enumerate(r[1].split("\n")) if (i, n) not in bad))
    assert repeated_lines.excessive_places(df.where("false")).count() == 0


COMMON = ["the", "a", "of", "was", "and", "to", "in", "that", "for", "it", "not", "had", "der", "die", "und", "le", "la", "et", "que"]


def test_p3_kinds(spark):
    sentence = "The keeper of the lamp had not seen the ferry, and it was late in the evening. "
    cases = {
        1: (sentence * 4, False), 2: ("\n".join(f"- item {a}" for a in VOCAB[:30]), True), 3: ("\n".join(f"{a}\t{i * 37}\t{i * 1.5}\tok" for i, a in enumerate(VOCAB[:20])), True),
        4: ("\n".join(f"2024-01-0{i % 9 + 1} 10:00:0{i % 9} INFO [x-{i}] A.b rc={i} t={i}ms" for i in range(12)), True), 5: (sentence * 3 + "\n- one\n- two", False), 6: (sentence + "\n" + "\n".join("%x" % (i * 7919 + 4096) + "  " + " ".join(f"{(i * j * 31) % 256:02x}" for j in range(1, 16)) for i in range(20)), True),
        7: (sentence.upper() * 3, False), 8: ("short", False), 9: (None, False), 10: (" " * 300, False), 11: ("{\n" + "\n".join(f'  "k_{i}": {i},' for i in range(30)) + "\n}", True),
    }
    df = spark.createDataFrame([(k, t, 1) for k, (t, _) in cases.items()] * 2, "id long, text string, chars int")
    words = spark.createDataFrame([("en", w) for w in COMMON] + [("en", None)], "lang string, word string")
    found = {r.id for r in text_quality.not_prose(df, words).collect()}
    assert found == {k for k, (_, bad) in cases.items() if bad}
    assert text_quality.not_prose(df.where("false"), words).count() == 0
    stats = {r.id: r for r in text_quality.statistics(df, words).collect()}
    assert stats[8].words == 1 and stats[8].mean_word_length == 5.0 and stats[9].words == 0 and stats[9].mean_word_length is None and len(stats) == len(cases)


def test_p5_pages(spark):
    page = """<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">About</a></li></ul></nav><!-- <p>hidden</p> --><div class="c1">
<h1>Old mills</h1><P>The mill stood by the river for many years, and nobody knew who had built it there.</P><p></p><div id="promo"><p>Subscribe to the Post newsletter. Enter your email</p></div>
<h2>Wheels</h2><p>Each wheel had twelve paddles of oak, which were changed whenever the water ran low in summer.</p><section><h2>References</h2><ol><li>Arden, B. (1990). Mills.</li></ol></section></div>
<footer><p>© 2020 Post and contributors.</p></footer></body></html>"""
    pages = spark.createDataFrame([(1, page, "x"), (1, page, "x"), (2, None, "x"), (3, "", "x"), (4, "<html></html>", "x"), (5, "<p>unclosed <b", "x"), (None, page, "x")], "id long, html string, main string")
    texts = spark.createDataFrame([(1, "Skip to content\nThe mill stood by the river for years.\n\n| a | 1 |\n| b | 2 |\n12 comments"), (2, None), (3, "")], "id long, text string")
    got = {(r.origin, r.record_id, r.block_no) for r in boilerplate.furniture(pages, texts).collect()}
    assert got == {("html", 1, k) for k in (0, 1, 5, 8, 9, 10)} | {("content", 1, 0), ("content", 1, 5)}
    bodies = {(r.origin, r.record_id): r.body for r in boilerplate.main_bodies(pages, texts).collect()}
    assert bodies["html", 1].split("\n")[0] == "Old mills" and bodies["content", 1] == "The mill stood by the river for years.\n| a | 1 |\n| b | 2 |"
    none = spark.createDataFrame([], "id long, html string")
    assert boilerplate.furniture(none, texts.where("false").select("id", "text")).count() == 0


def test_p5_smoothing():
    import numpy as np

    assert np.allclose(boilerplate.smoothed(np.ones(5)), 1) and len(boilerplate.smoothed(np.array([]))) == 0
    assert 1 < boilerplate.two_clusters(np.array([0.0, 0.1, 5.0, 5.1])) < 5


@pytest.fixture(scope="module")
def encoder():
    with open(tokens.default_rank_file(), "rb") as f:
        return tokens.encoder(f.read())


def test_p6_round_trip(spark, encoder):
    odd = ["", None, " ", "plain text", "<|endoftext|> stays text", "emoji 👩‍👩‍👧 mixed ЯЖ 日本 \x00\x1c\r\n\t", "a" * 5000, "   many   spaces   "]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(odd)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.token_ids(df).collect()}
    assert got == {i: encoder.encode_ordinary(t) if t else [] for i, t in enumerate(odd)}
    back = {r.doc_id: r.text for r in tokens.token_texts(tokens.token_ids(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(odd)}
    assert tokens.token_ids(df.where("false")).count() == 0


@pytest.mark.parametrize("size", [1, 7, 50])
def test_p6_pieces_are_safe(encoder, size):
    rng = random.Random(size)
    for alphabet in ("ab c'ts  \n.!é", "日本語。", "a' 1\x1c!\t  "):
        for _ in range(60):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 200)))
            pieces = list(tokens.safe_pieces(text, size))
            assert "".join(pieces) == text and [i for p in pieces for i in encoder.encode_ordinary(p)] == encoder.encode_ordinary(text)


def test_p7_water_filling():
    fill = mixing.water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 1000, "c": 1000}, 100)
    assert fill == {"a": 10.0, "b": 54.0, "c": 36.0}
    assert mixing.water_fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 20}, 100) == {"a": 10.0, "b": 20.0}
    assert mixing.water_fill({"a": 1.0, "b": 0.0}, {"a": 50, "b": 50}, 40) == {"a": 40.0, "b": 0.0} and mixing.water_fill({}, {}, 5) == {}


def test_p7_mix(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 4)), rng.choice([" A ", "a", "B"]) if i % 10 else rng.choice([None, "", "c"]), "x") for i in range(300)] + [(900, "", "a", "x"), (901, None, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, range string")
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "B ", 0.3, 2), ("m", "c", 0.2, 4), ("m", "none", 0.1, 4), ("n", "c", 1.0, 2), (None, "a", 1.0, 1), ("n", None, 1.0, 1)], "mix_name string, source string, target_share double, max_repeats long")
    selection, report = mixing.mixed(docs, targets, seed=1)
    chosen = selection.collect()
    caps = {("m", "a"): 1, ("m", "b"): 2, ("m", "c"): 4, ("n", "c"): 2}
    assert all(1 <= r.repeats <= caps[r.mix_name, r.source] for r in chosen) and len({(r.mix_name, r.doc_id) for r in chosen}) == len(chosen)
    rows_ = {(r.mix_name, r.source): r for r in report.collect()}
    assert set(rows_) == {*caps, ("m", "none")} and rows_["m", "none"].tokens == 0
    plan = {(m, s): (w, stock) for m, s, _, _, stock, w in mixing.plan_mixes(mixing.token_counts(docs.select("doc_id", mixing.source_key(F.col("source")).alias("source"), "text"), "text"), targets)}
    for key, r in rows_.items():
        assert abs(r.tokens - plan[key][0]) <= 60 and r.stock_tokens == plan[key][1]
    again = {(r.mix_name, r.doc_id, r.repeats) for r in mixing.mixed(docs.repartition(7), targets, seed=1)[0].collect()}
    assert again == {(r.mix_name, r.doc_id, r.repeats) for r in chosen}
    assert mixing.mixed(docs, targets.where("false"))[0].count() == 0 and mixing.mixed(docs.where("false"), targets)[0].count() == 0


def test_p8_pages(spark):
    rng = random.Random(9)
    names = ["Arden", "Weller", "Corwen", "Holt", "Dene"]

    def sentence():
        return f"The {rng.choice(VOCAB)} of {rng.choice(names)} was {rng.choice(VOCAB)} in the {rng.choice(VOCAB)}, and it had not been {rng.choice(VOCAB)} for the {rng.choice(VOCAB)}."

    good = [" ".join(sentence() for _ in range(rng.randint(3, 8))) for _ in range(150)]
    spam = [
        "cheap lamps best oars " * 40, ", ".join(rng.choice(["cheap lamp", "best oar", "fast rope"]) + " " + rng.choice(names) for _ in range(40)),
        "\n".join(f"- https://{rng.choice(VOCAB)}.example/{i}" for i in range(25)), "\n".join(f"[{rng.choice(VOCAB)} {rng.choice(VOCAB)}](https://{rng.choice(VOCAB)}.example/{i})" for i in range(20)),
        " ".join("#" + rng.choice(VOCAB).title() + rng.choice(VOCAB).title() for _ in range(40)), "Looking for a cheap lamp? Our cheap lamp is the cheap lamp for every cheap lamp. Order the cheap lamp today, the cheap lamp tomorrow! " * 4,
        sentence() + "\n\n" + "cheap lamp best rope " * 60,
    ]
    decoys = ["\n".join(f"{rng.choice(VOCAB)}\t{i * 31}\t{i / 7:.2f}" for i in range(30)), sentence() + "\nTags: lamps, oars, ropes", "\n".join(f"* Fix: {sentence()}" for _ in range(8)), sentence() + " " + "\n".join(f"Title, https://x.example/{i}. {sentence()}" for i in range(3))]
    rows = [(i, t) for i, t in enumerate([*good, *decoys])] + [(1000 + i, t) for i, t in enumerate(spam)] + [(2000, None), (2001, ""), (2002, " \n ")]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:5]], "id long, text string, bits int")
    words = spark.createDataFrame([(w,) for w in COMMON], "word string")
    assert {r.id for r in stuffing.stuffed_pages(df, words).collect()} == {1000 + i for i in range(len(spam))}
    assert stuffing.stuffed_pages(df.where("false"), words).count() == 0
    # pages the models were not trained on, judged by the models alone, without the evidence
    import numpy as np

    function = sorted({*COMMON, *stuffing.FUNCTION_WORDS.split()})
    known = stuffing.Tokens(function)
    models = stuffing.class_models(stuffing.encoded(df, function), known.size)
    new_spam = ["quick ferries old mills " * 30, ", ".join(rng.choice(["red kite", "tin cup", "wet oar"]) + " " + rng.choice(names) for _ in range(30)), "\n".join(f"- https://{rng.choice(VOCAB)}.example/{i}x" for i in range(15)), "Want a tin cup? Our tin cup is the tin cup for every tin cup. Order the tin cup today, the tin cup tomorrow! " * 3]
    new_good = [" ".join(sentence() for _ in range(5)) for _ in range(20)] + ["\n".join(f"{rng.choice(VOCAB)}\t{i * 17}\t{i / 3:.2f}" for i in range(20)), "\n".join(f"* Fix: {sentence()}" for _ in range(6))]

    def share(text):
        seg = stuffing.segments(text, known)
        lengths, codes = np.array([len(x[1]) for x in seg]), np.array([c for x in seg for c in x[1]])
        prose, stuffed, other = (m.bits(lengths, codes) for m in models)
        size = np.array([x[0] for x in seg])
        return size[stuffed < np.minimum(prose, other)].sum() / size.sum()

    assert all(share(t) > 0.5 for t in new_spam) and not any(share(t) > 0.5 for t in new_good)
    with pytest.raises(ValueError, match="2000 words"):
        stuffing.page_scores(df, spark.range(2001).select(F.concat(F.lit("w"), "id").alias("word")))
