"""Registered queries against their SQL, verdicts and packing against plain versions, and the pipeline's stages on odd rows."""

import random

import duckdb
import numpy as np
import pytest
from test_text_ops import DOCS, odd_docs

import corpus_pipeline
from veridrift.llm import packing, quality, queries
from veridrift.llm.words import MIX, hashed_words

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels", "conversations")


def same(spark, name, folder):
    """Whether a query's rows are those of its SQL over the tables of a folder."""
    df = queries.queries()[name](spark, str(folder))
    con = duckdb.connect()
    for t in TABLES:
        parts = "/*.parquet" if (folder / f"{t}.parquet").is_dir() else ""
        if (folder / f"{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{parts}'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    expected = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == expected
    return len(expected)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, tmp_path, name):
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    assert same(spark, name, tmp_path) > 0


def odd_tables(spark, folder):
    """Null and empty values, equal texts, passages of many documents, and columns with the results' own names."""
    rng = random.Random(8)
    passages = [" ".join(f"w{k}x{j}" for j in range(70)) for k in range(3)]
    texts = [None, "", " \t\n", *passages, *(" ".join(rng.choices([*passages, "lone words here", "ü 日本"], k=rng.randint(1, 4))) for _ in range(30)), passages[0] * 40]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["a", "", None]), 1, "x", 5) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept_sha256 string, part int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, None), (3, None, 1), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(i, "u", rng.choice([None, "", "<p>a</p>", "ü" * 3000]), "x", 3) for i in range(40)]
    spark.createDataFrame(pages, "page_id long, url string, html string, payload_digest string, shard int").write.parquet(f"{folder}/pages.parquet")
    vectors = [(i, [rng.choice([0.5, -0.25, 0.0]) for _ in range(4)], 1.0) for i in range(0, 400, 4)] + [(500, None, 0.0), (600, [1.0, None, 0.0, 0.0], 0.0), (700, [float("nan")] * 4, 0.0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score double").write.parquet(f"{folder}/embeddings.parquet")
    talk = [(c, rng.choice([0, 1, None]), rng.choice(["user", None]), rng.choice(["hi", "", None, "ü"]), 9) for c in range(0, 230, 7)]
    talk = list({(c, t): r for r in talk for c, t in [(r[0], r[1])]}.values())
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string, depth int").write.parquet(f"{folder}/conversations.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_of_odd_rows_equals_its_sql(spark, tmp_path, name):
    odd_tables(spark, tmp_path)
    assert same(spark, name, tmp_path) > 0


def brute_probability(model, text):
    """The classifier's probability by plain integers, one n-gram at a time."""
    bits, mix, mix32 = quality.BITS, int(MIX), [int(x) for x in quality._MIX32]
    h = [int(hashed_words(w.decode())[0]) for w in text.encode().split()]
    words = [(x * mix) % 2**64 >> 64 - bits for x in h] + [((x * mix + y) * mix) % 2**64 >> 64 - bits for x, y in zip(h, h[1:])]
    chars = [sum(ord(c) * m for c, m in zip(text[i : i + n], mix32)) * mix32[0] % 2**32 >> 32 - bits for n in (3, 4) for i in range(len(text) - n + 1)]
    z = model.bias + sum(float(model.words[i]) for i in words) / (len(words) + quality.SHRINK) + sum(float(model.chars[i]) for i in chars) / (len(chars) + quality.SHRINK)
    return 1 / (1 + np.exp(-(model.scale * z + model.shift)))


def test_quality_verdicts_equal_a_plain_version(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, labels)
    got = {r.doc_id: r for r in queries.op2_quality_rules(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert model.key and len(got) == len(rows)
    for r in rows:
        p = brute_probability(model, r.text or "")
        assert got[r.doc_id].probability == pytest.approx(p, abs=1e-6)
        if abs(p - 0.5) > 1e-6:
            assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and p >= 0.5)


def test_quality_learns_one_text_of_a_repeated_id(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["stone", "river"] if i % 3 else ["$$$", "%%%"], k=30))) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    once = quality.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    more = rows + [(i, t) for i, t in rows[:50] for _ in range(20)] + [(i, "~ " + t) for i, t in rows] + [(i, None) for i in range(200)]
    again = quality.learn(spark.createDataFrame(more, "doc_id long, text string"), labels)
    assert once.key and np.array_equal(once.words, again.words) and (once.bias, once.scale, once.shift) == (again.bias, again.scale, again.shift)


def plain_pack(lengths, capacities, overhead):
    """Best-fit decreasing by looking at every open bin and every waiting item: (item, capacity, offset) by bin."""
    largest, bins, waiting = max(capacities), [], []
    for item, n in enumerate(lengths):
        bins += [[largest, [(item, largest)]] for _ in range(n // largest)]
        if n % largest:
            waiting.append((n % largest, item))
    waiting.sort(key=lambda x: (-x[0], x[1]))
    while waiting:
        n, item = waiting.pop(0)
        open_bins = [(size - sum(m for _, m in own), k) for k, (size, own) in enumerate(bins)]
        fits = [x for x in open_bins if x[0] >= n]
        if fits:
            bins[min(fits)[1]][1].append((item, n))
            continue
        costs = []
        for place, size in enumerate(capacities):
            if size >= n:
                left = size - n
                for m, _ in waiting:
                    left -= m if m <= left else 0
                costs.append(((size + overhead) / (size - left), place))
        bins.append([capacities[min(costs)[1]], [(item, n)]])
    return sorted((min(c for c in capacities if c >= sum(n for _, n in own)), own) for _, own in bins)


def least_total(lengths, capacities):
    """The least sum of capacities over all ways to divide the items."""
    best = [float("inf")]

    def place(i, bins):
        if i == len(lengths):
            best[0] = min(best[0], sum(min(c for c in capacities if c >= b) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= max(capacities):
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("capacities, overhead", [((8, 16, 32), 0), ((8, 16, 32), 3), ((10,), 2), ((5, 30), 1)])
def test_packing_equals_a_plain_version(capacities, overhead):
    rng = random.Random(9)
    for _ in range(150):
        lengths = [rng.choice([0, 1, 4, 4, 7, 8, 9, 16, 17, 32, 33, 70, rng.randint(1, 40)]) for _ in range(rng.randint(1, 40))]
        bins = {}
        for item, _, n, number, capacity, offset in packing.pack_shard(lengths, capacities, overhead):
            bins.setdefault((number, capacity), []).append((offset, item, n))
        got = sorted((capacity, [x[1:] for x in sorted(own)]) for (_, capacity), own in bins.items())
        assert got == plain_pack(lengths, capacities, overhead)


def test_packing_is_near_the_least_total():
    rng, used, least = random.Random(10), 0, 0
    for _ in range(60):
        lengths = [rng.randint(1, 16) for _ in range(rng.randint(1, 7))]
        bins = {number: capacity for _, _, _, number, capacity, _ in packing.pack_shard(lengths, (4, 8, 16), 0)}
        best = least_total(lengths, (4, 8, 16))
        assert best <= sum(bins.values()) <= 1.5 * best
        used, least = used + sum(bins.values()), least + best
    assert used <= 1.1 * least


LABELS = "doc_id long, quality int, toxic int, text string"


def stage_inputs(spark, folder, docs):
    path = f"{folder}/documents.parquet"
    docs.write.parquet(path)
    spark.createDataFrame([(0, 1, 0, "x"), (None, 0, 1, None), (3, None, None, "y")], LABELS).write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(path)


def contents(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stage_on_odd_rows(spark, tmp_path, name, stage):
    docs = stage_inputs(spark, tmp_path, odd_docs(spark))
    out = stage(spark, docs, str(tmp_path))
    assert out.schema.simpleString() == docs.schema.simpleString()
    before, after = contents(docs), contents(out)
    if name == "suffix_array_dedup":
        assert after == before  # no two of them share 50 words under different ids
        return
    assert set(after) <= set(before)
    by_id = [r.doc_id for r in out.collect()]
    if name == "simhash_near_dedup":
        assert by_id.count(None) == 1 and by_id.count(3) <= 1
    else:
        assert by_id.count(50) == 0 and by_id.count(0) == 0  # null and empty texts


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, tmp_path, name, stage):
    docs = stage_inputs(spark, tmp_path, odd_docs(spark).limit(0))
    assert stage(spark, docs, str(tmp_path)).count() == 0


def test_pipeline_of_nothing_and_of_odd_rows(spark, tmp_path):
    (tmp_path / "none").mkdir(), (tmp_path / "odd").mkdir()
    stage_inputs(spark, tmp_path / "none", odd_docs(spark).limit(0))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    long = " ".join(f"plain{k} words" for k in range(40))
    more = spark.createDataFrame([(100, long, "en", "x", 1, "k", "k", 7, 1, 2), (101, long, "en", "x", 1, "k", "k", 7, 1, 2)], DOCS)
    stage_inputs(spark, tmp_path / "odd", odd_docs(spark).union(more))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()} & {100, 101} == {100}
