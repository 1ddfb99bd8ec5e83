"""Operators over whole corpora, against brute force."""

import collections
import gc
import gzip
import pathlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import common, components, decontaminate, jaccard, langid, quality_model, sharding, warc

DOCS = "doc_id long, text string, n string, comp string, row string, h string, shard string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], DOCS)


# --- Jaccard ---


def brute_components(rows):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i].append(frozenset([tuple(w)] if 0 < len(w) < 4 else [tuple(w[k : k + 4]) for k in range(len(w) - 3)]))
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for x, (i, a) in enumerate(flat):
        for j, b in flat[:x]:
            if 100 * len(a & b) >= 85 * len(a | b):
                p, q = root(i), root(j)
                top[max(p, q)] = min(p, q)
    return {i: root(i) for i in top}, {(i, len(s)) for i, ss in sets.items() for s in ss}


def corpus(rng, n):
    vocabulary = [f"w{k}" for k in range(40)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
            k = rng.randrange(len(words))
            words[k : k + rng.choice((0, 1))] = [rng.choice(vocabulary + ["É", "Q"])]
        rows.append((i * 3 % (n * 2), " ".join(words)))
    return rows


@pytest.mark.parametrize("part", [jaccard.LIST, 3])
def test_components_equal_all_pairs(spark, part):
    rng = random.Random(part)
    rows = corpus(rng, 150) + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE\ttwo"), (905, "one two three"), (906, "x " * 3000), (907, "x y " * 2000)]
    rows += [rows[0], rows[0], (rows[1][0], rows[60][1]), (None, rows[2][1]), (None, None)]
    wanted, sizes = brute_components([r for r in rows if r[0] is not None])
    got = jaccard.similar_components(docs(spark, rows), part=part).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == wanted[r["doc_id"]]
            assert (r["doc_id"], r["n_shingles"]) in sizes
    kept = jaccard.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(i for i, _ in left if i is not None) == sorted(set(wanted.values()))
    # Without an id: a copy goes, what is no copy stays.
    assert [t for i, t in left if i is None] == [None]


def test_near_copies_of_ids_that_are_text_or_missing(spark):
    rng = random.Random(8)
    rows = corpus(rng, 80)
    names = {i: f"k{i:04d}" for i, _ in rows}
    wanted, _ = brute_components(rows)
    df = spark.createDataFrame([(names[i], t, "x") for i, t in rows] + [(None, "a b c d e", "x")], "doc_id string, text string, id string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_components(df).collect()}
    assert got == {names[i]: names[c] for i, c in wanted.items()} | {None: None}
    assert sorted(r["doc_id"] or "" for r in jaccard.keep_one(df).collect()) == ["", *sorted({names[c] for c in wanted.values()})]
    # Rows without ids alone: one of each group of copies stays, and rows without words stay.
    lost = spark.createDataFrame([(None, t) for _, t in rows] + [(None, ""), (None, None)], "doc_id long, text string")
    kept = [r["text"] for r in jaccard.keep_one(lost).collect()]
    alone, _ = brute_components(list(enumerate(t for _, t in rows)))
    assert len(kept) == len(set(alone.values())) + 2 and "" in kept and None in kept
    assert len({alone[[t for _, t in rows].index(t)] for t in kept if t}) == len(set(alone.values()))


def test_guests_of_long_lists_meet_every_part(spark):
    """A hot token in every prefix: a third of the members are in one component, the others each in one of their own or in pairs across parts."""
    rng = random.Random(4)
    rows = [(i, "hot hot hot hot " + " ".join(f"c{k}" for k in range(10)) + f" v{i % 3}") for i in range(30)]
    for i in range(60):
        words = [f"u{i // 2}x{k}" for k in range(26)]
        rows.append((100 + i, "hot hot hot hot " + " ".join(words) + (f" e{i}" if rng.random() < 0.7 else "")))
    wanted, _ = brute_components(rows)
    for part in (2, 7):
        got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_components(docs(spark, rows), part=part).collect()}
        assert got == wanted


def test_checkpoints_of_earlier_rounds_go(spark):
    folder = pathlib.Path(common.shared_folder(spark).removeprefix("file:"))
    count = lambda: len(list(folder.glob("rdd-*")))
    before = count()
    with common.scratch(spark):
        found = jaccard.similar_components(docs(spark, corpus(random.Random(1), 60)))
        assert count() - before <= 4  # signatures, members, components
        assert found.count() == 60
    assert count() == before


def test_shuffles_of_earlier_rounds_go(spark):
    """Spark keeps them until the driver collects its garbage, which a driver with room left puts off."""
    jvm = spark.sparkContext._jvm
    held = lambda: jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()

    def least(most):
        until = time.monotonic() + 10
        while held() > most and time.monotonic() < until:
            time.sleep(0.1)
        return held()

    gc.collect()
    jvm.System.gc()
    before = least(0)
    with common.scratch(spark):
        kept = jaccard.keep_one(docs(spark, corpus(random.Random(1), 60)))
        assert least(before + 10) <= before + 10
        assert kept.count()


@pytest.mark.parametrize(("edges", "stars"), [([], True), ([(2, 1), (3, 1), (9, 4)], True), ([(2, 1), (3, 2)], False), ([(3, 1), (3, 2)], False)])
def test_rounds_end_with_stars(spark, edges, stars):
    df = spark.createDataFrame(edges, "u long, v long")
    assert components._are_stars(df) == stars
    after = sorted(map(tuple, components._small_star(components._large_star(df)).collect()))
    assert (after == edges) == stars


def test_jaccard_of_nothing(spark):
    assert jaccard.similar_components(docs(spark, [])).count() == 0
    assert jaccard.keep_one(docs(spark, [])).count() == 0


def test_bounds_of_the_filters():
    for n in range(1, 200):
        for m in range(n, 240):
            least = jaccard.overlap_needed(n, m, 85)
            assert 100 * least >= 85 * (n + m - least) and 100 * (least - 1) < 85 * (n + m - least + 1)
        assert jaccard.prefix_length(n, 85) == n - -(-85 * n // 100) + 1


def test_long_paths_join(spark):
    edges = [(i, i + 1) for i in range(120)] + [(500, 400), (400, 450), (7, 7)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(121)) and {found[i] for i in (400, 450, 500)} == {400}


# --- decontamination ---

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(rows, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])] |= set() if i is None else {str(i)}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["a", "B", "é", "É", "x1", "the", "of", "q"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice((" ", ", ", "\n", "--")) for _ in range(n))
    items = [(i, text(rng.randint(8, 30))) for i in range(12)] + [(50, "the q"), (51, "É"), (52, None), (53, " ,"), (None, only := text(12)), (2, items2 := text(15)), (2, items2)]
    rows = [(i, text(rng.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, text(9) + items[i][1] + text(5)) for i in range(12)] + [(200, None), (201, ""), (None, items[0][1]), (203, only), (100, "other"), (100, "other")]
    rows += [(202, text(20000) + items[3][1])]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, item string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in decontaminate.contamination(docs(spark, rows), bench).collect()), key=repr)
    assert got == sorted(brute_hits(rows, items), key=repr)
    left = collections.Counter((r["doc_id"], r["text"]) for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect())
    assert left == collections.Counter(row for row, (_, _, n, _) in zip(rows, brute_hits(rows, items), strict=True) if n == 0)
    assert (None, items[0][1]) not in left and (100, "other") in left


def test_contamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digests(docs(spark, []), bench).count() == 0
    rows = decontaminate.digests(docs(spark, [(1, "a b"), (2, None)]), bench).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in sorted(rows)] == [(2, 0, False), (0, 0, False)]


# --- sharding ---


@pytest.mark.parametrize("n", [0, 1, 5, 500])
def test_shards_are_even_and_slots_dense(spark, n):
    rows = [(i, None if i % 50 == 3 else f"t{i % 7}é") for i in range(n)] + [(7, "same")] * (n // 2) + [(None, None)] * (n > 10)
    df = docs(spark, rows)
    got = sharding.digests(df, 24).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = collections.defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 24
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_hot_rows_spread_and_files_hold_all(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")] * 300 + [(i, "y") for i in range(300)], "doc_id long, text string")
    got = sharding.shuffle_into_shards(df, 4, F.lit(10), bucket_rows=50).cache()
    hot = collections.Counter(r["shard"] for r in got.where("text = 'x'").collect())
    assert min(hot.values()) > 50
    sharding.write_shards(got, str(tmp_path / "shards"))
    assert df.sparkSession.read.parquet(str(tmp_path / "shards")).count() == 600


def test_whole_texts_are_placed(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(sharding, "cut", lambda df: kept.append(common.cut(df)) or kept[-1])
    rows = [(i, "long " * 200000 if i == 3 else f"text {i}") for i in range(40)] + [(5, "text 5")] * 30
    got = sharding.digests(docs(spark, rows), 4).collect()
    placed = [r for df in kept if "__row" in df.columns for r in df.select("__row.*").collect()]
    assert collections.Counter((r["key"], r["text"]) for r in placed) == collections.Counter(rows)
    assert sum(r["size"] for r in got) == sum(len(t) + 8 for _, t in rows)


# --- WARC ---


def test_revisits(spark):
    none = None
    rows = [
        # id, type, url, ts, etag, last_modified, digest, headers, body
        (1, "response", "http://a.example/x?utm_source=q", "2024-01-01 00:00:00", "e1", none, "d1", {"server": "s", "etag": "e1", "date": "1"}, "one"),
        (2, "revisit", "https://www.a.example/x#f", "2024-01-05 10:00:00", "e1", none, none, {"date": "2", "server": "other"}, none),
        (3, "response", "http://a.example/x/", "2024-01-06 00:00:00", "e2", none, none, {}, "two"),
        (4, "revisit", "http://A.example:80/x", "2024-01-06 00:00:00", "e2", none, none, none, none),
        (5, "revisit", "http://a.example/x", "2024-01-07 00:00:00", "e1", none, none, {}, none),
        (6, "revisit", "http://a.example/x", "2023-01-01 00:00:00", "e1", none, none, {}, none),
        (7, "revisit", none, "2024-02-01 00:00:00", none, none, none, {}, none),
        (8, "revisit", "http://a.example/x", none, none, none, none, {}, none),
        (9, "request", "http://a.example/x", "2024-01-07 00:00:00", none, none, none, {}, none),
        (5, "revisit", "http://a.example/x", "2024-01-07 00:00:00", "e1", none, none, {}, none),
    ]
    schema = "record_id long, type string, url string, ts string, etag string, last_modified string, digest string, headers map<string,string>, body string"
    records = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("status", F.lit("clash")).withColumn("block", F.lit(1))
    for seconds in (1, 3600, 10**9):
        resolved = warc.resolve_revisits(records, seconds)
        got = collections.defaultdict(list)
        for r in warc.attach_payload(resolved, records, ["body"]).collect():
            got[r["record_id"]].append(r)
        assert got[1][0]["status"] == "full" and got[1][0]["body"] == "one"
        assert (got[2][0]["status"], got[2][0]["source_id"], got[2][0]["body"]) == ("resolved", 1, "one")
        assert got[2][0]["headers"] == {"server": "s", "etag": "e1", "date": "2"}
        assert (got[4][0]["status"], got[4][0]["source_id"], got[4][0]["headers"]) == ("resolved", 3, {})
        assert [r["status"] for r in got[5]] == ["mismatch"] * 2 and got[5][0]["body"] is None
        assert [got[k][0]["status"] for k in (6, 7, 8)] == ["unresolved"] * 3 and 9 not in got
    assert warc.resolve_revisits(records.limit(0)).count() == 0


def test_many_revisits_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(("response", "revisit")), f"http://h{rng.randrange(3)}.example/p", rng.randrange(40), rng.choice(("a", "b"))) for i in range(300)]
    records = spark.createDataFrame(rows, "record_id long, type string, url string, t long, etag string").select(
        "record_id", "type", "url", F.timestamp_seconds("t").alias("ts"), "etag", F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"), F.create_map().cast("map<string,string>").alias("headers")
    )
    got = {r["record_id"]: (r["status"], r["source_id"]) for r in warc.resolve_revisits(records, 5).collect()}
    for i, kind, url, t, tag in rows:
        if kind == "revisit":
            before = [x for x in rows if x[1] == "response" and x[2] == url and (x[3], x[0]) < (t, i)]
            last = max(before, key=lambda x: (x[3], x[0]), default=None)
            assert got[i] == (("unresolved", None) if last is None else ("resolved", last[0]) if last[4] == tag else ("mismatch", None))


def test_files_are_read(spark, tmp_path):
    def record(kind, url, block):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{url}-{kind}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    body = "héllo".encode()
    parts = [record("response", "http://a/", b"HTTP/1.1 200 OK\r\nETag: e\r\nX: y\r\n\r\n" + body), record("revisit", "http://a/", b"HTTP/1.1 304 Not Modified\r\nETag: e\r\n\r\n"), record("warcinfo", "", b"x: y")]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(rows) == 6
    full = [r for r in rows if r["type"] == "response"]
    assert all(bytes(r["body"]) == body and r["etag"] == "e" and r["http_status"] == "200" and r["headers"]["x"] == "y" for r in full)
    assert all(r["body"] is None for r in rows if r["type"] == "revisit")


def test_files_are_streamed(spark, tmp_path):
    """Large bodies, names with spaces and signs, an empty file, a gzip of all records in one member."""
    body = random.Random(3).randbytes(3 << 20)
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    (tmp_path / "a b%20#1.warc").write_bytes(record * 4)
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record * 3, 1))
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path))
    assert "content" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [bytes(r["body"]) == body for r in rows.select("body").collect()] == [True] * 7


# --- learned models ---

SYLLABLES = {"xx": ["ba", "bo", "bi"], "yy": ["ku", "ke", "ki"], "zz": ["ño", "ñe", "ñi"]}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_languages_of_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, spoken(rng, lang, rng.randint(1, 60)), lang) for i, lang in enumerate(rng.choice("xyz") * 2 for _ in range(400))]
    rows += [(900, None, "xx"), (901, "", "yy"), (902, "12 ?!", "zz"), (903, "bo ba", None), (None, "ku ke", "xx"), (904, "ба бо", None), (905, "bo " * 60000, "xx"), (905, "bo " * 60000, "xx")]
    df = spark.createDataFrame([(i, t, lang, 0.5, True) for i, t, lang in rows], "doc_id long, text string, lang string, score double, rejected boolean")
    model = langid.fit(df, common.id_crc() % 3 != 1)
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)
    known = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900]
    assert sum(r["lang"] == r["lang_pred"] for r in known) >= 0.98 * len(known)
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[902]["rejected"]
    assert by[903]["lang_pred"] == "xx" and by[904]["lang_pred"] in SYLLABLES and by[904]["rejected"]
    empty = langid.fit(df.limit(0), common.id_crc() % 3 != 1)
    assert {r["lang_pred"] for r in langid.predict(df, empty).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_unlearned_languages_and_junk_are_rejected(spark):
    rng = random.Random(6)
    rows = [(i, spoken(rng, lang, rng.randint(20, 60)), lang) for i, lang in enumerate(("xx", "yy", "zz") * 200)]
    # An odd labelled row of each language must not widen its radius.
    rows += [(1000 + i, "q" * (i + 1) + " ### 12", lang) for i, lang in enumerate(("xx", "yy", "zz"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.col("doc_id").isNotNull())
    other = [" ".join("".join(rng.choice(("wro", "sht", "gly", "prv", "nck")) for _ in range(3)) for _ in range(40)) for _ in range(30)]
    junk = ["vvvv jjjj " * 9, "q", "qwq wqw ### 1 2 3", "\u0431\u0430 \u0431\u043e"]
    clean = [spoken(rng, lang, 30) for lang in ("xx", "yy", "zz") * 20]
    planted = spark.createDataFrame([(i, t) for i, t in enumerate(other + junk + clean)], "doc_id long, text string")
    kept = {r["doc_id"] for r in langid.drop_rejected(planted, model).collect()}
    assert kept == set(range(len(other + junk), len(other + junk + clean)))


def test_quality_of_held_out_texts(spark):
    rng = random.Random(4)
    good = lambda: ". ".join(" ".join(rng.choice(("river", "stone", "walks", "slowly", "under", "green")) + str(rng.randrange(99)) for _ in range(9)) for _ in range(5)) + "."
    bad = lambda: " ".join(rng.choice(("buy###", "now&&&", "WIN!!", "x|y")) for _ in range(40))
    rows = [(i, (good if i % 3 else bad)()) for i in range(600)] + [(900, None), (901, ""), (None, "x"), (902, "w " * 90000), (902, "w " * 90000)]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(5, None, 1), (None, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(df, labels, common.id_crc() % 5 != 0)
    assert 0 < len(model.rules) < 100
    got = quality_model.score(df, model).withColumn("held", common.held_out("doc_id", 5, 0)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held"] and r["doc_id"] < 600]
    assert len(held) > 60 and all((r["score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in held)
    for y, score in (([], 0.5), ([1, 1], 0.99), ([0, 0], 0.01)):
        import numpy as np

        one = quality_model.learn(np.zeros((len(y), len(quality_model.STATISTICS))), np.array(y))
        assert quality_model.score(df.limit(1), one).first()["score"] == pytest.approx(score)
    assert quality_model.score(df.limit(0), model).count() == 0


# --- pipeline ---


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    item = spoken(rng, "xx", 25)
    rows = [(i, spoken(rng, "xx" if i % 2 else "yy", 50), "xx" if i % 2 else "yy", "s", 1) for i in range(60)]
    rows[7] = (7, rows[5][1], "xx", "s", 1)
    rows[9] = (9, rows[9][1] + " " + item, "xx", "s", 1)
    rows[11] = (11, rows[11][1] + " ba@bo.bi", "xx", "s", 1)
    rows += [(100, None, None, None, None), (101, "", "xx", "s", 0), (102, "?!", "xx", "s", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "personal_data", "bpe"]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(60)) - {7, 9}
    assert got[11]["text"].endswith(" [EMAIL]") and got[11]["n_chars"] == len(got[11]["text"])
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in got.values())
    docs_ = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs_.limit(0), str(tmp_path))
        assert made.count() == 0
        assert name == "bpe" or made.columns == docs_.columns


def test_near_copies_of_the_pipeline_share_five_words(spark, tmp_path):
    import corpus_pipeline

    words = [f"w{i}" for i in range(1200)]
    pairs = [(words[:100], words[:100] + words[500:520]), (words[100:150], [*words[100:124], "other", *words[125:150]]), (words[200:300], words[200:300] + words[600:640])]
    rows = [(10 * i + j, " ".join(w)) for i, pair in enumerate(pairs) for j, w in enumerate(pair)]
    left = corpus_pipeline.ngram_jaccard(spark, docs(spark, rows), str(tmp_path))
    # Five-word similarities: 96/116, 41/51 and 96/136; four-word ones are below 0.85.
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 10, 20, 21]
