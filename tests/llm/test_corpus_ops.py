"""Repeats, packing, archives, search and the pipeline against brute force and exact round trips."""

import random
import time
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veridrift.llm import langid, packing, quality, repeats, substring_dedup, suffix_dedup, topk, warc
from veridrift.llm.common import shared_folder


def brute_copies(rows, similarity=0.8):
    """The least id reachable through pairs of sets of five-word shingles that are as similar."""
    split = [(i, (t or "").encode().lower().split()) for i, t in rows]
    sets = [(i, {tuple(ws[s : s + 5]) for s in range(max(1, len(ws) - 4))} if ws else set()) for i, ws in split]
    group = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if i < j and group[i] != group[j] and (a == b or len(a & b) >= similarity * len(a | b) > 0):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    return group


def brute_cut(rows, window):
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, ws in split:
        if i is not None:
            for s in range(len(ws) - window + 1):
                key = tuple(ws[s : s + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, ws in split:
        gone = set()
        for s in range(len(ws) - window + 1):
            if i is not None and least[tuple(ws[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()))
    return sorted(out, key=str)


def repeating(n=60, seed=4):
    rng = random.Random(seed)
    passages = [[f"p{k}x{j}" for j in range(rng.randint(10, 90))] for k in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [f"u{rng.randint(0, 400)}" for _ in range(rng.randint(1, 30))]
            if rng.random() < 0.3:
                words += ["again"] * rng.randint(1, 40)
        rows.append((rng.randint(0, 10_000), rng.choice([" ", "\n", " \t"]).join(words)))
    return rows + [(None, " ".join(passages[0])), (20_000, None), (20_001, ""), (20_002, " ".join(passages[1])), (20_002, " ".join(passages[2])), (20_002, " ".join(passages[2]))]


@pytest.mark.parametrize("cut,window", [(substring_dedup.remove_repeats, 13), (suffix_dedup.remove_passages, 50), (suffix_dedup.remove_passages, 13), (substring_dedup.remove_repeats, 3)])
def test_repeats_equal_brute_force(spark, cut, window):
    rows = repeating()
    docs = spark.createDataFrame([(i, t, "k", "k", 1) for i, t in rows], "doc_id long, text string, key string, keys string, known int")
    got = cut(docs, window=window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, " ".join(r.kept_text.split())) for r in got), key=str) == brute_cut(rows, window)
    assert all(sum(x["words"] for x in r.repeats) == r.n_removed for r in got)
    assert any(r.n_removed for r in got)


def test_repeats_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(docs).count() == 0
    assert suffix_dedup.remove_passages(docs).count() == 0


@pytest.mark.parametrize("cut", [substring_dedup.remove_repeats, suffix_dedup.remove_passages])
def test_hot_passages_and_very_long_texts(spark, monkeypatch, cut):
    """Anchors and prefixes that most documents hold go window by window; two texts have 60,000 words."""
    monkeypatch.setattr(repeats, "HOT", 3)
    rng = random.Random(6)
    shared = [f"h{k}" for k in range(40)]
    rows = []
    for i in range(80):
        own = [f"u{rng.randint(0, 30)}" for _ in range(rng.randint(0, 25))]
        rows.append((rng.randint(0, 500), " ".join(own + shared[rng.randint(0, 5) :] + own[::-1])))
    long = [f"u{rng.randint(0, 30_000)}" for _ in range(60_000)]
    rows += [(900, " ".join(long)), (901, " ".join(long[:30_000] + shared + long[30_000:]))]
    got = cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window=13).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, " ".join(r.kept_text.split())) for r in got), key=str) == brute_cut(rows, 13)


@pytest.mark.parametrize("cut", [substring_dedup.remove_repeats, suffix_dedup.remove_passages])
def test_many_rows_of_one_id_take_linear_work(spark, cut):
    """10,000 rows under two ids take at most twice the time of rows with ids of their own (and some seconds of slack)."""
    rng = random.Random(11)
    passages = [[f"p{k}x{j}" for j in range(20)] for k in range(300)]
    texts = [" ".join([f"u{rng.randint(0, 50_000)}" for _ in range(25)] + rng.choice(passages) + [f"v{rng.randint(0, 50_000)}" for _ in range(15)]) for _ in range(4_900)]
    texts += texts[:50] * 2  # rows repeated as a whole
    rng.shuffle(texts)
    seconds = {}
    for ids, rows in (("own", [(i, t) for i, t in enumerate(texts * 2)]), ("two", [(i, t) for i in (7, 9) for t in texts])):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        begun = time.monotonic()
        got = cut(docs, window=13).collect()
        seconds[ids] = time.monotonic() - begun
        assert sorted(((r.doc_id, r.n_words, r.n_removed, " ".join(r.kept_text.split())) for r in got), key=str) == brute_cut(rows, 13)
    assert seconds["two"] <= 2 * seconds["own"] + 5


@pytest.mark.parametrize("window,gram", [(6, 2), (5, 5), (9, 3)])
def test_places_of_one_hash_are_told_apart_by_their_words(window, gram):
    """Were all grams hashed to one key, the groups would still give what brute force gives."""
    rng = random.Random(window)
    texts = [(i, " ".join(f"v{rng.randint(0, 3)}" for _ in range(rng.randint(0, 40)))) for i in range(40)]
    shape = repeats.Shape(window, gram)
    every = np.unique(np.concatenate([shape.representatives(repeats.hashed_words(t))[0] for _, t in texts])).view(np.int64)
    group = [(0, x.left, x.words, i, 0, x.start, x.n) for i, t in texts for x in repeats.places(t, shape, every, every[:0])]
    want = brute_cut(texts, window)
    by_suffix = {}
    for _, gap, words, *rest in group:
        own = words.split(b" ")
        key = b" ".join([*own[gap : gap + gram], b""])
        by_suffix.setdefault(key, []).append((key, b"".join(w + b" " for w in own[gap + gram :]), b" ".join(own[:gap]), *rest))
    suffixes = [r for g in by_suffix.values() for r in suffix_dedup.extended(sorted(g, key=lambda x: x[1]), window)]
    for found in (list(substring_dedup.extended(group, window)), suffixes):
        got = []
        for i, t in texts:
            runs = pa.scalar([{"start": a, "run": n} for d, _, a, n in found if d == i] or None, pa.list_(pa.struct([("start", pa.int32()), ("run", pa.int32())])))
            n, gone, _, kept = repeats._cut(t, runs, window)
            got.append((i, n, gone, " ".join(kept.split())))
        assert sorted(got, key=str) == want


def test_merged_runs_hold_the_same_windows():
    rng = random.Random(11)
    for _ in range(200):
        found = [(rng.randint(0, 2), rng.randint(-1, 1), rng.randint(0, 40), rng.randint(1, 6)) for _ in range(rng.randint(0, 25))]
        every = {(d, p, at) for d, p, start, n in found for at in range(start, start + n)}
        got = list(repeats.merged(found))
        spread = [(d, p, at) for d, p, start, n in got for at in range(start, start + n)]
        assert len(spread) == len(set(spread)) and set(spread) == every
        assert not {(d, p, start + n) for d, p, start, n in got} & {r[:3] for r in got}  # none touch


def test_common_words_of_suffixes():
    for a, b, n in ((b"", b"", 0), (b"x y ", b"x y ", 2), (b"x y ", b"x yz ", 1), (b"x ", b"x y ", 1), (b"q ", b"r ", 0)):
        assert suffix_dedup.common_words(a, b) == suffix_dedup.common_words(b, a) == n


def test_cut_keeps_columns_and_unrepeated_texts(spark):
    rows = repeating(30)
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), 5, "x") for i, t in rows], "doc_id long, text string, n_chars long, _repeat_keys int, Keys string")
    out = suffix_dedup.cut_passages(docs, window=13)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, None if r.text is None else " ".join(r.text.split())) for r in out.collect()), key=str)
    want = sorted(((i, None if t is None else kept) for (i, t), (_, _, _, kept) in zip(sorted(rows, key=str), sorted(brute_cut(rows, 13), key=str))), key=str)
    assert sorted(x[1] or "" for x in got) == sorted(x[1] or "" for x in want)
    assert all(r.text is None or r.n_chars == len(r.text) for r in out.collect())


def check_bins(rows, lengths, capacities):
    bins, pieces = defaultdict(list), defaultdict(int)
    for r in rows:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
            pieces[r.doc_id] += r.n_tokens
    for members in bins.values():
        members.sort(key=lambda r: r.offset)
        at = 0
        for r in members:
            assert r.offset == at
            at += r.n_tokens
        capacity = members[0].capacity
        assert {r.capacity for r in members} == {capacity} and capacity == min(c for c in capacities if c >= at)
    assert dict(pieces) == {i: n for i, n in lengths.items() if n}
    return bins


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(6)
    lengths = {i: rng.choice([0, 1, 40, 500, 513, 4096, 4097, 20_000, rng.randint(1, 3000)]) for i in range(700)}
    table = spark.createDataFrame([(i, n, "b") for i, n in lengths.items()], "doc_id long, n_tokens long, bin_id string")
    rows = packing.pack(table, shard_docs=200).collect()
    bins = check_bins(rows, lengths, packing.CAPACITIES)
    used = sum(m[0].capacity for m in bins.values())
    assert sum(lengths.values()) / used > 0.9
    assert {r.doc_id for r in rows} == set(lengths)


def test_packing_edges(spark):
    table = spark.createDataFrame([(None, 10), (1, None), (1, 5), (1, 5), (2, -4)], "doc_id long, n_tokens long")
    rows = packing.pack(table).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.bin_id is None) for r in rows) == [("1", 0, True), ("1", 5, False), ("1", 5, False), ("2", 0, True), ("None", 10, False)]
    assert packing.pack(table.limit(0)).count() == 0


def test_best_fit_places_where_least_room_is_left():
    packed = packing.pack_shard([400, 300, 110, 200], capacities=(512,), overhead=0)
    where = {item: number for item, _, _, number, _, _ in packed}
    assert where[0] == where[2] and where[1] == where[3]


PAGES = [(5, "http://a", "<p>one</p>"), (2, "http://b x", "<p>one</p>"), (9, None, None), (11, "u", ""), (3, "u", "ü" * 5000), (2, "http://b x", "<p>one</p>"), (None, "u", "<p>one</p>"), (None, "u", "lone"), (10**12, "u", "far")]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*r, 1, "x") for r in PAGES], "page_id long, url string, html string, shard int, sha1 string")
    folder = shared_folder(spark)
    manifest = warc.write(pages, folder, file_bytes=200, shard_bytes=300)
    assert manifest.count() > 3
    rows = warc.read(manifest, folder).collect()
    assert sorted((str(r.page_id), r.payload_bytes) for r in rows) == sorted((str(i), len((h or "").encode())) for i, _, h in PAGES)
    by = defaultdict(list)
    for r in rows:
        by[r.page_id].append(r)
    assert sorted(r.record_type for r in by[2]) == ["response", "revisit"] and by[5][0].refers_to == 2
    assert by[9][0].record_type == "response" and by[11][0].refers_to == 9
    assert sorted((r.record_type, r.refers_to) for r in by[None]) == [("response", None), ("revisit", 2)]
    assert all(r.payload_digest == warc.digest((h or "").encode()) for i, _, h in PAGES for r in by[i] if r.payload_bytes == len((h or "").encode()) and i is not None)
    assert {r.payload.decode() for r in rows if r.payload is not None} == {"<p>one</p>", "", "ü" * 5000, "lone", "far"}


def test_archives_are_deterministic_and_threshold_holds(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")

    def contents(df):
        folder = f"file://{tmp_path}/{random.random()}"
        names = sorted(r.file for r in warc.write(df, folder, file_bytes=400, shard_bytes=400).collect())
        return {n: open(f"{folder[7:]}/{n}", "rb").read() for n in names}

    first, second = contents(pages), contents(pages.repartition(7).orderBy("url"))
    assert first == second and first
    folder = shared_folder(spark)
    rows = warc.read(warc.write(pages, folder, min_bytes=1000), folder).collect()
    assert all(r.record_type == "response" for r in rows)
    folder = shared_folder(spark)
    assert warc.read(warc.write(pages.limit(0), folder), folder).count() == 0


def test_archive_shards_are_bounded_whatever_the_ids(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(None, f"n{k}", text(2000)) for k in range(60)] + [(None, "r", "same" * 500)] * 40 + [(7, f"i{k}", text(2000)) for k in range(60)]
    rows += [(8, f"r{k % 5}", "eight" * 400) for k in range(50)] + [(9, "e", "")] * 60 + [(100 + k, "u", text(2000)) for k in range(60)] + [(2**62, "far", "far"), (-(2**62), "far", "eight" * 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    def files(df):
        folder = f"file://{tmp_path}/{random.random()}"
        manifest = warc.write(df, folder, shard_bytes=20_000)
        return folder, manifest, {r.file: open(f"{folder[7:]}/{r.file}", "rb").read() for r in manifest.collect()}

    folder, manifest, first = files(pages)
    assert first == files(pages.repartition(9).orderBy("html"))[2]
    got = warc.read(manifest, folder).collect()
    assert sorted((str(r.page_id), r.payload_bytes) for r in got) == sorted((str(i), len(h)) for i, _, h in rows)
    assert [r.refers_to for r in got if r.page_id == 8] == [-(2**62)] * 50
    assert sorted(str(r.refers_to) for r in got if r.page_id == 9) == ["9"] * 59 + ["None"]
    # a file is a shard here; each holds at most its bytes, a record as payload and 512 bytes
    assert max(r.records for r in manifest.collect()) <= 40
    largest = [sum(r.payload_bytes + 512 for r in warc.read(manifest.where(manifest.file == f), folder).collect()) for f in list(first)[:12]]
    assert max(largest) <= 20_000


def test_packing_spreads_a_repeated_id(spark):
    table = spark.createDataFrame([(1, 10)] * 3000 + [(k, 10) for k in range(2, 200)], "doc_id long, n_tokens long").repartition(4)
    rows = packing.pack(table, shard_docs=200).collect()
    shards = defaultdict(int)
    for r in rows:
        shards[r.bin_id.split("-")[0]] += 1
    assert len(rows) == 3198 and max(shards.values()) < 400


def brute_top(rows, every, k):
    good = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(x) for _, x in good), default=0)
    good = [(i, np.pad(x, (0, width - len(x)))) for i, x in good]
    out = []
    for at, (q, x) in enumerate(good):
        if q % every == 0:
            best = sorted((-int(x @ y), i) for other, (i, y) in enumerate(good) if other != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)] + [(600 + i, [0.5] * 8) for i in range(60)]
    rows += [(2000, [float("nan")] * 8), (2010, None), (2020, [None] * 8), (None, [1.0] * 8), (2030, [float("inf")] + [0.0] * 7)]
    vectors = spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<float>, cell int, part int")
    got = sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % 10 == 0, k=10).collect()))
    assert got == brute_top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 10, 10)
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    few = topk.top_k(vectors.where("vec_id < 4"), F.col("vec_id") == 0, k=10).collect()
    assert sorted(r.rank for r in few) == [1, 2, 3]


def test_top_k_tells_rows_of_one_id_apart(spark, monkeypatch):
    """Query ids in several rows, with equal and other vectors; every row asks, and finds its twins."""
    for name, value in {"BLOCK_ROWS": 16, "GROUP_ROWS": 4}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.integers(-3, 4, 4).astype(float).tolist()) for i in rng.integers(0, 60, 150)]
    rows += [(20, [3.0, 3.0, 3.0, 3.0])] * 3 + [(20, [-1.0, 2.0]), (40, [3.0, 3.0, 3.0, 3.0]), (41, [3.0] * 4), (41, [3.0] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=10).collect()))
    assert got == brute_top(rows, 20, 10)
    only = topk.top_k(spark.createDataFrame(rows[-7:-4], vectors.schema), F.col("vec_id") == 20, k=10).collect()
    assert sorted(map(tuple, only)) == sorted([(20, rank, 20, 36 * 1024 * 1024) for rank in (1, 2)] * 3)


def check_tree(points):
    """Every node covers its points; children cover their parent's, centred more than its radius by ``BASE`` apart."""
    tree = topk.CoverTree(points)
    assert sorted(tree.rows(0).tolist()) == list(range(len(points)))
    for node, children in enumerate(tree.children):
        own = points[tree.rows(node)]
        apart = np.sqrt(((own - tree.centers[node]) ** 2).sum(axis=1))
        assert apart.max() <= tree.radii[node] + 1e-9
        if len(children):
            assert sorted(np.concatenate([tree.rows(c) for c in children]).tolist()) == sorted(tree.rows(node).tolist())
            c = tree.centers[children]
            between = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))[~np.eye(len(c), dtype=bool)]
            assert len(c) > 1 and between.min() > tree.radii[node] / topk.BASE and tree.radii[children].max() <= tree.radii[node] / topk.BASE
            assert tree.at[node] in {tree.at[x] for x in children}
        else:
            assert len(own) <= topk.LEAF or tree.radii[node] == 0
    return tree


def test_dual_tree_divides_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    centers = rng.integers(-400, 400, (12, 6))
    clustered = np.concatenate([c + rng.integers(-9, 9, (60, 6)) for c in centers]).astype(np.int64)
    same = np.repeat(rng.integers(-400, 400, (3, 6)), 100, axis=0)
    rows = duckdb.sql("SELECT embedding FROM '/root/testdata/sf0.01/embeddings.parquet' WHERE embedding IS NOT NULL").fetchall()
    real = np.floor(np.array([r[0] for r in rows if len(r[0]) == 64 and None not in r[0]], float) * 1024).astype(np.int64)
    for data, levels in ((clustered, 3), (same, 2), (real, 3)):
        tree = check_tree(data.astype(float))
        depth = [1] * len(tree.children)
        for node in reversed(range(len(depth))):
            depth[node] += max((depth[c] for c in tree.children[node]), default=0)
        assert depth[0] >= levels
        ids, pruned = np.arange(len(data)), [0, 0]
        found = topk.search(data[::50], ids[::50], data, ids, 10, np.full(len(data[::50]), -np.inf), pruned)
        for q, own in zip(ids[::50], found):
            assert own == sorted((-int(data[q] @ y), int(i)) for i, y in zip(ids, data) if i != q)[:10]
        assert pruned[0] > 0 or data is same


def test_search_of_large_components_is_exact_or_fails(spark):
    big = np.array([[2**40, -(2**40)], [2**40 + 1, 5], [7, 2**40]], np.int64)
    want = [sorted((-sum(int(a) * int(b) for a, b in zip(big[q], big[i])), i) for i in range(3) if i != q) for q in range(3)]
    with pytest.raises(OverflowError):
        topk._matches(topk.search(big, np.arange(3), big, np.arange(3), 2, np.full(3, -np.inf)), np.arange(3))
    assert topk.search(big, np.arange(3), big, np.arange(3), 2, np.full(3, -np.inf)) == want
    far = spark.createDataFrame([(0, [1e18]), (1, [2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.top_k(far, F.col("vec_id") == 0).count()


def test_topk_in_cells_and_groups(spark, monkeypatch):
    """Clusters make several cells; a third of the rows are one vector; some are shorter; groups and blocks are small."""
    for name, value in {"BLOCK_ROWS": 16, "GROUP_ROWS": 4, "SLOT_GROUPS": 3}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(9)
    centers = rng.normal(0, 3, (6, 5))
    rows = [(i, (centers[i % 6] + rng.normal(0, 0.1, 5)).tolist()[: 3 if i % 17 == 0 else 5]) for i in range(200)]
    rows += [(200 + i, centers[0].tolist()) for i in range(100)] + [(300, []), (301, None), (302, [0.0, None])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % 5 == 0, k=7).collect()))
    assert got == brute_top(rows, 5, 7)


def test_pipeline_stages_against_their_operators(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, sf_dir)
    assert known.columns == columns
    learned = langid.learn(docs)
    und = {r.doc_id for r in langid.identify(docs, learned).collect() if r.lang_pred == "und"}
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in docs.collect()} - und
    good = stages["quality_rules"](spark, known, sf_dir)
    model = quality.learn(known, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.score(known, model).collect() if r.kept}
    path = shared_folder(spark)
    good.write.parquet(path)
    good = spark.read.parquet(path)
    one = stages["simhash_near_dedup"](spark, good, sf_dir)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == set(brute_copies([(r.doc_id, r.text) for r in good.collect()]).values())
    cut = stages["suffix_array_dedup"](spark, one, sf_dir)
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert cut.columns == columns
    assert sorted((r.doc_id, " ".join(r.text.split())) for r in cut.collect()) == sorted((i, " ".join(k.encode().decode().split())) for i, _, _, k in brute_cut(rows, 50))
    packed = stages["bestfit_packing"](spark, cut, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in cut.collect()}
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()
